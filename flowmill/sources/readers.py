"""Flow-record files, reference tables, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.functions import scalar

FLOW_COLUMNS = ("ts_start", "ts_end", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "packets", "bytes", "tcp_flags", "direction_hint")
REQUIRED = ("src_ip", "dst_ip", "proto")


def flow_records(spark: SparkSession, path: str) -> DataFrame:
    """Flow-record CSV as packets, one event a record at its end (or start, if that is later); rows that cannot be read
    are left out, ``flow_record_faults`` counts them."""
    return _flow_rows(_flow_text(spark, path)).filter("ok").drop("ok", "direction_hint")


def _flow_text(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"flow records lack {missing}")
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in FLOW_COLUMNS])


def _flow_rows(text: DataFrame) -> DataFrame:
    start, end = (scalar.timestamp_ns(F.col(c)) for c in ("ts_start", "ts_end"))
    ts = F.when(end > start, end).otherwise(F.coalesce(start, end))
    ip = r"^(\d{1,3}\.){3}\d{1,3}$"
    number = lambda c, d: F.coalesce(F.col(c).try_cast("long"), F.lit(d))
    rows = text.select(
        ts.alias("ts_ns"),
        scalar.whole(ts, 1000).alias("ts_us"),
        scalar.proto_number(F.col("proto")).alias("proto"),
        F.when(F.col("src_ip").rlike(ip), scalar.ip_to_int(F.col("src_ip"))).alias("src_ip"),
        F.when(F.col("dst_ip").rlike(ip), scalar.ip_to_int(F.col("dst_ip"))).alias("dst_ip"),
        number("src_port", 0).cast("int").alias("src_port"),
        number("dst_port", 0).cast("int").alias("dst_port"),
        F.greatest(number("bytes", 0), F.lit(0)).alias("length"),
        F.coalesce(scalar.flags_number(F.col("tcp_flags")), F.lit(0)).alias("tcp_flags"),
        F.greatest(number("packets", 1), F.lit(1)).cast("int").alias("packets"),
        F.lit(True).alias("from_flow_record"),
        "direction_hint",
    )
    ok = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull() & F.col("proto").isNotNull() & (F.col("ts_ns") > 0)
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


def flow_record_faults(spark: SparkSession, path: str) -> DataFrame:
    """(direction_hint, records, malformed) of a flow-record file."""
    return _flow_rows(_flow_text(spark, path)).groupBy(F.coalesce("direction_hint", F.lit("")).alias("direction_hint")).agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("ok")).alias("malformed"))


def merged(sources: list[DataFrame], order: list[str]) -> DataFrame:
    """Several sources in one order of time."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources).orderBy(*order)


def clamped(packets: DataFrame, source: str, position: str) -> DataFrame:
    """packets whose times never go back within their source, with ``moved`` where they did."""
    w = Window.partitionBy(source).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    top = F.max("ts_ns").over(w)
    return packets.withColumn("_t", top).withColumn("moved", F.col("_t") > F.col("ts_ns")).withColumn("ts_ns", F.col("_t")).drop("_t")


def json_reference(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A reference table kept as one JSON document."""
    return spark.read.schema(schema).json(path, multiLine=True)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
