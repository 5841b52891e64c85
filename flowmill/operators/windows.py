"""Event-time windows over any keyed table; times are whole microseconds in ``ts``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import scalar


def bucket(ts: Column, width: int) -> Column:
    """Index of the grid-aligned window of ``width`` that holds ts."""
    return scalar.whole(ts.cast("long"), width)


def tumbling(df: DataFrame, keys: list[str], ts: str, width: int, *aggs: Column) -> DataFrame:
    return df.groupBy(*keys, bucket(F.col(ts), width).alias("bucket")).agg(*aggs)


def sliding(df: DataFrame, keys: list[str], ts: str, width: int, step: int, *aggs: Column) -> DataFrame:
    """Windows of ``width`` that start every ``step``; each row goes to width/step of them and is summed map-side."""
    per = width // step
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda k: bucket(F.col(ts), step) - k)).alias("start")
    return df.select("*", starts).groupBy(*keys, "start").agg(*aggs)


def sessions(df: DataFrame, keys: list[str], ts: str, idle: int, *aggs: Column) -> DataFrame:
    """Runs of rows less than ``idle`` apart."""
    w = Window.partitionBy(*keys).orderBy(ts)
    gap = F.col(ts) - F.lag(ts).over(w)
    opens = F.when(gap >= idle, 1).otherwise(0)
    return df.withColumn("session", opens).withColumn("session", F.sum("session").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "session").agg(*aggs)


def two_generations(windowed: DataFrame, keys: list[str], value: str) -> Column:
    """Larger of a window's value and that of the window just before, over rows with a ``bucket``."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    before = F.when(F.col("bucket") - F.lag("bucket").over(w) == 1, F.lag(value).over(w))
    return F.greatest(F.col(value), F.coalesce(before, F.lit(0)))


def gaps(df: DataFrame, keys: list[str], ts: str, *ties: str) -> DataFrame:
    """df with ``gap``: time since the key's row before."""
    w = Window.partitionBy(*keys).orderBy(ts, *ties)
    return df.withColumn("gap", F.col(ts) - F.lag(ts).over(w))


def moments(x: Column) -> dict[str, Column]:
    """Population moments, excess kurtosis."""
    return {"mean": F.avg(x), "std": F.stddev_pop(x), "skew": F.skewness(x), "kurt": F.kurtosis(x), "least": F.min(x), "most": F.max(x)}


def ring(df: DataFrame, keys: list[str], order: list[str], n: int) -> Window:
    """Frame of a key's last n rows."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)


def running(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def repeats(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """df with ``run``: how many rows in a row up to this one have the same value."""
    w, v = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys, value).orderBy(*order)
    island = F.row_number().over(w) - F.row_number().over(v)
    return df.withColumn("_island", island).withColumn("run", F.row_number().over(Window.partitionBy(*keys, value, "_island").orderBy(*order))).drop("_island")


def timeline(df: DataFrame, keys: list[str], ts: str, bounds: tuple[float, float, float, float] = (0.42, 0.45, 0.53, 0.56)) -> DataFrame:
    """df with ``fraction`` of the key's time span and its split: train, calibration or test, with embargoes between."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(ts).over(w), F.max(ts).over(w)
    x, (a, b, c, d) = F.col("fraction"), bounds
    split = F.when(x < a, "train").when(x < b, "embargo").when(x < c, "calibration").when(x < d, "embargo").otherwise("test")
    return df.withColumn("fraction", F.when(hi > lo, (F.col(ts) - lo) / (hi - lo)).otherwise(0.0)).withColumn("split", split)


def prefix_sums(df: DataFrame, order: list[str], value: Column, name: str, parts: int = 64) -> DataFrame:
    """df with ``name``: the sum of ``value`` over the rows before each row in the order of all rows, without one task that
    holds them all: ranges between quantiles of the first (numeric) column are summed apart and then put together."""
    cuts = sorted(set(df.approxQuantile(order[0], [k / parts for k in range(1, parts)], 0.002)))
    part = sum((F.when(F.col(order[0]) >= x, 1).otherwise(0) for x in cuts), F.lit(0))
    d = df.withColumns({"_part": part, "_value": value})
    sums = d.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    # at most ``parts`` rows on either side
    base = sums.alias("a").join(sums.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b._sum"), F.lit(0)).alias("_base"))
    here = F.coalesce(F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_here", here).join(F.broadcast(base), "_part").withColumn(name, F.col("_here") + F.col("_base")).drop("_part", "_value", "_here", "_base")


def min_gap(df: DataFrame, keys: list[str], order: list[str], ts: str, gap: int) -> DataFrame:
    """df with ``repaired``: the key's times in order, each moved to at least ``gap`` after the one before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    place = F.row_number().over(w) * gap
    shifted = df.withColumn("_p", place).withColumn("_m", F.col(ts) - F.col("_p"))
    return shifted.withColumn("repaired", F.max("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_p")).drop("_p", "_m")
