"""The function surface (scalar, aggregate and grouped pandas functions, table functions) and streams."""

import uuid

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from flowmill.plans.registry import query
from flowmill.streaming import jobs

LOCAL_FALLBACK = "/tmp/checkpoints/flowmill-streams"  # of local sessions alone


def checkpoint(spark, name):
    """A new folder in the cluster's shared one; only a local session may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or LOCAL_FALLBACK).rstrip('/')}/{name}-{uuid.uuid4().hex[:10]}"


@query("SELECT event_id, round(sqrt(value + 1), 6) AS r FROM events")
def pandas_udf_scalar(t):
    @F.pandas_udf("double")
    def root(x: pd.Series) -> pd.Series:
        return (x + 1) ** 0.5

    return t.events.select("event_id", F.round(root("value"), 6).alias("r"))


@query("SELECT event_type, round(median(value), 6) AS m FROM events GROUP BY 1")
def pandas_udf_agg(t):
    @F.pandas_udf("double")
    def middle(x: pd.Series) -> float:
        return float(x.median())

    return t.events.groupBy("event_type").agg(F.round(middle("value"), 6).alias("m"))


@query("SELECT user_id, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def apply_in_pandas(t):
    def span(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "n": [len(rows)], "spread": [round(rows["value"].max() - rows["value"].min(), 6)]})

    return t.events.select("user_id", "value").groupBy("user_id").applyInPandas(span, "user_id long, n long, spread double")


@query("""WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages), p AS (SELECT host, string_split(host, '.') AS x FROM h)
SELECT host, array_to_string(x[i:], '.') AS suffix FROM (SELECT host, x, unnest(range(1, len(x) + 1)) AS i FROM p)""")
def udtf_suffixes(t):
    @F.udtf(returnType="suffix: string")
    class Suffixes:
        def eval(self, name: str):
            parts = (name or "").split(".")
            for i in range(len(parts)):
                yield (".".join(parts[i:]),)

    t.spark.udtf.register("flowmill_suffixes", Suffixes)
    t.pages.select(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host")).distinct().createOrReplaceTempView("flowmill_hosts")
    return t.spark.sql("SELECT host, suffix FROM flowmill_hosts, LATERAL flowmill_suffixes(host)")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id, epoch_us(ts) // 86400000000")
def stream_tumbling(t):
    s = jobs.windowed_counts(jobs.event_stream(t.spark, t.folder), "user_id", "1 day", "30 days")
    out = jobs.run_available(s, "complete", checkpoint(t.spark, "tumbling"))
    return out.select("user_id", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, epoch_us(ts) // 21600000000 * 21600000000 - k * 21600000000 AS start, count(*) AS n FROM events, range(4) r(k) GROUP BY ALL")
def stream_sliding(t):
    s = jobs.sliding_counts(jobs.event_stream(t.spark, t.folder), "user_id", "24 hours", "6 hours", "30 days")
    return jobs.run_available(s, "complete", checkpoint(t.spark, "sliding")).select("user_id", "start", "n")


@query()
def stream_rate_alerts(t):
    s = jobs.rate_alerts(jobs.event_stream(t.spark, t.folder), "event_type", 86_400_000_000, 20, 2 * 86_400_000_000)
    return jobs.run_available(s, "append", checkpoint(t.spark, "rates"))


# a list of this package: no table holds it
@query()
def method_coverage(t):
    rows = [Row(method=m, area=a) for m, a in (("flood", "volume"), ("burst", "volume"), ("scan", "reconnaissance"), ("exfiltration", "data"), ("names", "dns"), ("tunnel", "dns"), ("pairs", "encrypted"), ("beacon", "command"), ("rarity", "novelty"))]
    return t.spark.createDataFrame(rows).agg(F.count(F.lit(1)).alias("methods"), F.count_distinct("area").alias("areas"))
