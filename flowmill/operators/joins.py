"""Join shapes that Spark has no operator for.  Reference sides are broadcast only under a counted bound; beyond it the
same join runs on an equi key (grid cells or suffixes), so neither side has to fit in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import scalar

SMALL_ROWS = 50_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def interval_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, cell: int) -> DataFrame:
    """Pairs with start <= at <= end: both sides meet in grid cells of ``cell``; a range goes to each cell it covers."""
    cells = F.explode(F.sequence(F.floor(F.col(start) / cell).cast("long"), F.floor(F.col(end) / cell).cast("long"))).alias("_cell")
    r = ranges.select("*", cells)
    if is_small(ranges):
        r = F.broadcast(r)
    return points.withColumn("_cell", F.floor(F.col(at) / cell).cast("long")).join(r, "_cell").filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_cell")


def first_label(points: DataFrame, ranges: DataFrame, id_: str, at: str, start: str, end: str, label: str, rank: str, cell: int, default: str = "benign") -> DataFrame:
    """points with the label of the first range (by ``rank``) that holds them, else ``default``.  Of equal ranges only the
    first can win, so they fold before the join."""
    ranges = ranges.groupBy(start, end).agg(F.min_by(label, rank).alias(label), F.min(rank).alias(rank))
    hits = interval_join(points.select(id_, at), ranges, at, start, end, cell).groupBy(id_).agg(F.min_by(label, rank).alias("label"))
    return points.join(hits, id_, "left").withColumn("label", F.coalesce("label", F.lit(default)))


def cidr_join(rows: DataFrame, networks: DataFrame, ip: str, port: str) -> DataFrame:
    """rows with the ``reason`` of the first network (cidr, ports, reason, rank) that holds address and port, else null.

    A network is split into cells of 16 leading bits and a cell's networks make one row, so the join is by an equi key and
    gives each row one partner at most: nothing is grouped behind it."""
    low, high = scalar.cidr_range(F.col("cidr"))
    n = networks.withColumn("_lo", low).withColumn("_hi", high)
    n = n.select("rank", "_lo", "_hi", "ports", "reason", F.explode(F.sequence(F.shiftright("_lo", 16), F.shiftright("_hi", 16))).alias("_cell"))
    n = n.groupBy("_cell").agg(F.array_sort(F.collect_list(F.struct("rank", "_lo", "_hi", "reason", "ports"))).alias("_here"))
    if is_small(networks):
        n = F.broadcast(n)
    at = F.col(ip).cast("long")
    fits = F.filter("_here", lambda x: at.between(x["_lo"], x["_hi"]) & ((F.size(x["ports"]) == 0) | F.array_contains(x["ports"], F.col(port).cast("int"))))
    return rows.withColumn("_cell", F.shiftright(at, 16)).join(n, "_cell", "left").withColumn("reason", F.get(fits, F.lit(0))["reason"]).drop("_cell", "_here")


def suffix_join(rows: DataFrame, domains: DataFrame, name: str, domain: str) -> DataFrame:
    """rows left-joined to the longest of ``domains`` that equals the name or ends it after a dot: every suffix of the
    name is an equi key."""
    d = domains.select(F.col(domain).alias("_suffix")).distinct()
    if is_small(d):
        d = F.broadcast(d)
    names = rows.select(name).distinct()
    suffixes = scalar.let(F.split(F.col(name), "[.]"), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.concat_ws(".", F.slice(p, i, F.size(p) - i + 1))))
    best = names.select(name, F.explode(suffixes).alias("_suffix")).join(d, "_suffix").groupBy(name).agg(F.max_by("_suffix", F.length("_suffix")).alias("matched"))
    return rows.join(best, name, "left")


def hold(rows: DataFrame, keys: list[str], ts: str, fired: Column, value: Column, tolerance: int, ties: list[str]) -> DataFrame:
    """rows with ``held``: the value of the key's last row that fired, at most ``tolerance`` back."""
    w = Window.partitionBy(*keys).orderBy(ts, *ties).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(fired, F.struct(F.col(ts).alias("t"), value.alias("v"))), ignorenulls=True).over(w)
    return rows.withColumn("_h", last).withColumn("held", F.when(F.col(ts) - F.col("_h.t") <= tolerance, F.col("_h.v"))).drop("_h")


def last_known(rows: DataFrame, near: list[str], wide: list[str], order: list[str], value: str) -> DataFrame:
    """rows with ``known``: the latest value before or at the row within the near key, else within the wide key."""
    at = lambda k: F.last(value, ignorenulls=True).over(Window.partitionBy(*k).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("known", F.coalesce(at(near), at(wide)))


def reconcile(a: DataFrame, b: DataFrame, key: str, doc: str) -> DataFrame:
    """Keys of two stores that one lacks or that differ: (key, state)."""
    j = a.select(key, F.col(doc).alias("_a"), F.lit(1).alias("_in_a")).join(b.select(key, F.col(doc).alias("_b"), F.lit(1).alias("_in_b")), key, "full")
    state = F.when(F.col("_in_a").isNull(), "only_second").when(F.col("_in_b").isNull(), "only_first").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return j.withColumn("state", state).filter("state IS NOT NULL").select(key, "state")
