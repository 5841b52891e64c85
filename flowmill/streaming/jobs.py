"""Structured Streaming: windowed counts with a watermark, keyed state with first-seen anchors, an idempotent sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALERT_STATE = "start long, n long, last_fired long, latest long"
ALERT_OUT = "key string, start long, n long"


def event_stream(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """The events table as a stream of files, with ``time`` as its event time."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    if per_trigger:
        source = source.option("maxFilesPerTrigger", per_trigger)
    # a stream reads folders; the glob keeps it to the one table
    return source.option("pathGlobFilter", "events.parquet").load(folder).withColumn("time", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, key: str, width: str, late: str) -> DataFrame:
    """Counts by key and window; rows later than ``late`` behind the watermark are dropped and counted by Spark."""
    w = events.withWatermark("time", late).groupBy(F.window("time", width), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.unix_micros("window.start").alias("start"), key, "n", "total")


def session_counts(events: DataFrame, key: str, idle: str, late: str) -> DataFrame:
    w = events.withWatermark("time", late).groupBy(F.session_window("time", idle), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.unix_micros("session_window.start").alias("start"), key, "n")


def deduplicated(alerts: DataFrame, late: str) -> DataFrame:
    """One row an alert id within the watermark."""
    return alerts.withWatermark("time", late).dropDuplicatesWithinWatermark(["id"])


def rate_alerts(events: DataFrame, key: str, width_us: int, least: int, cooldown_us: int) -> DataFrame:
    """Keyed rate rule whose window starts at the key's first event and rolls on its next event past the width; an alert
    only after the cooldown.  The state of a key is four numbers and leaves after an event-time timeout."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n, fired, latest = state.get if state.exists else (-1, 0, -(1 << 62), 0)
        rows = pd.concat(list(batches)).sort_values("us")
        out = []
        for us in rows["us"].tolist():
            if us < start:
                continue  # older than the open window
            if start < 0 or us - start >= width_us:
                start, n = us, 0
            n, latest = n + 1, max(latest, us)
            if n >= least and us - fired >= cooldown_us:
                out.append((str(name[0]), start, n))
                fired = us
        state.update((start, n, fired, latest))
        state.setTimeoutTimestamp(max(latest // 1000 + (width_us + cooldown_us) // 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "start", "n"])

    keyed = events.withWatermark("time", "1 hour").select(F.col(key).cast("string").alias("key"), F.unix_micros("time").alias("us"), "time")
    return keyed.groupBy("key").applyInPandasWithState(step, ALERT_OUT, ALERT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there into a table beside its checkpoint and return that table.  A batch that runs again
    writes its own folder anew; in complete mode the last batch is the result."""
    spark, schema, path = stream.sparkSession, stream.schema, f"{checkpoint}-out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([], schema).write.mode("append").parquet(path if mode == "complete" else f"{path}/batch=-1")
    return spark.read.schema(schema).parquet(path)


def sliding_counts(events: DataFrame, key: str, width: str, step: str, late: str) -> DataFrame:
    """Counts by key and window of ``width`` that starts every ``step``."""
    w = events.withWatermark("time", late).groupBy(F.window("time", width, step), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.unix_micros("window.start").alias("start"), key, "n")


def late_rows(progress: list[dict]) -> int:
    """Rows that a query's progress reports as dropped behind the watermark."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in progress for s in p.get("stateOperators", []))


def append_once(stream: DataFrame, path: str, checkpoint: str):
    """Exactly-once Parquet sink: a batch that runs again writes the same folder anew."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
