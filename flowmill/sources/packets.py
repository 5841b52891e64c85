"""The packet event and the relational tables seen as packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TLS = T.StructType([T.StructField("ja4", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("alpn", T.StringType()), T.StructField("sni_present", T.BooleanType()), T.StructField("ext_count", T.IntegerType()), T.StructField("is_client_hello", T.BooleanType())])
DNS = T.StructType([T.StructField("qname", T.StringType()), T.StructField("qtype", T.IntegerType()), T.StructField("qname_len", T.IntegerType()), T.StructField("is_response", T.BooleanType()), T.StructField("answer_count", T.IntegerType()), T.StructField("rcode", T.IntegerType())])
#: Times are nanoseconds in ts_ns and microseconds in ts_us; there is no payload.
PACKET = T.StructType(
    [
        T.StructField("ts_ns", T.LongType(), False),
        T.StructField("ts_us", T.LongType(), False),
        T.StructField("proto", T.IntegerType()),
        T.StructField("src_ip", T.LongType()),
        T.StructField("dst_ip", T.LongType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("length", T.LongType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("ttl", T.IntegerType()),
        T.StructField("tcp_window", T.IntegerType()),
        T.StructField("tcp_mss", T.IntegerType()),
        T.StructField("tcp_opts", T.ArrayType(T.IntegerType())),
        T.StructField("packets", T.IntegerType()),
        T.StructField("from_flow_record", T.BooleanType()),
        T.StructField("icmp_type", T.IntegerType()),
        T.StructField("icmp_code", T.IntegerType()),
        T.StructField("tls", TLS),
        T.StructField("dns", DNS),
    ]
)


def events_as_packets(events: DataFrame) -> DataFrame:
    """The driver's event table as packets: user_id is the source, the port props.k the destination (hosts 0 to 9 by
    its last digit), value the length in whole bytes, and event_type gives protocol and flags."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    flags = F.when(kind == "signup", 2).when(kind == "click", 18).when(kind == "view", 16).when(kind == "purchase", 17).otherwise(4)
    return events.select(
        F.col("event_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.when(kind == "view", 17).otherwise(6).alias("proto"),
        F.col("user_id").alias("src_ip"),
        (k % 10).cast("long").alias("dst_ip"),
        (F.col("user_id") % 1000 + 1024).cast("int").alias("src_port"),
        k.alias("dst_port"),
        F.floor("value").cast("long").alias("length"),
        flags.alias("tcp_flags"),
        F.lit(1).alias("packets"),
    )


#: The same projection in DuckDB SQL, for oracles.
EVENTS_AS_PACKETS_SQL = """
SELECT event_id, epoch_us(ts) AS ts_us, CASE WHEN event_type = 'view' THEN 17 ELSE 6 END AS proto, user_id AS src_ip,
  CAST(json_extract_string(props, '$.k') AS INT) % 10 AS dst_ip, user_id % 1000 + 1024 AS src_port,
  CAST(json_extract_string(props, '$.k') AS INT) AS dst_port, CAST(floor(value) AS BIGINT) AS length,
  CASE event_type WHEN 'signup' THEN 2 WHEN 'click' THEN 18 WHEN 'view' THEN 16 WHEN 'purchase' THEN 17 ELSE 4 END AS tcp_flags,
  1 AS packets FROM events"""
