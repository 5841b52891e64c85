"""Ordered folds: moving baselines, cooldowns, quotas.

Each takes an array that is already in order (one element a closed window or event of one key; windows are aggregated
before, so an array is as long as the key's windows) and runs as one JVM expression.  ``ordered`` builds such arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowmill.functions.scalar import let


def ordered(order: Column, *values: Column) -> Column:
    """Aggregate: the group's rows as structs (t, v0, v1, ...) in order of t."""
    return F.array_sort(F.collect_list(F.struct(order.alias("t"), *[v.alias(f"v{i}") for i, v in enumerate(values)])))


def ewma(xs: Column, alpha: float) -> Column:
    """Mean that starts at the first value."""
    return F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs), F.lit(1))), F.get(xs, F.lit(0)).cast("double"), lambda m, x: m + alpha * (x - m))


CHUNK = 256


def running(xs: Column, start: Column, step, out: str = "double") -> Column:
    """Array of the states' ``out`` (of that type) after each element; a state has ``out`` and what ``step(state, x)`` needs.

    Outputs are gathered CHUNK at a time: appending to one array at each step would copy it each time."""

    def fold(items: Column, state: Column, take, kind: str) -> Column:
        return F.aggregate(items, F.struct(state.alias("s"), F.array().cast(f"array<{kind}>").alias("outs")), take)

    def one(a: Column, x: Column) -> Column:
        s = step(a["s"], x)
        return F.struct(s.alias("s"), F.concat(a["outs"], F.array(s["out"])).alias("outs"))

    def chunked(items: Column) -> Column:
        def some(a: Column, k: Column) -> Column:
            inner = fold(F.slice(items, k * CHUNK + 1, F.lit(CHUNK)), a["s"], one, out)
            return let(inner, lambda r: F.struct(r["s"].alias("s"), F.concat(a["outs"], F.array(r["outs"])).alias("outs")))

        chunks = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.flatten(fold(chunks, start, some, f"array<{out}>")["outs"])

    return let(xs, chunked)


def ewma_deviation(xs: Column, alpha: float, warmup: int) -> Column:
    """Deviation of each value from the moving mean before it, in moving standard deviations; 0 while warming up.

    The first value sets the mean; then mean += a*d and var = (1-a)(var + a*d*d)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"), F.lit(0.0).alias("out"))

    def step(s: Column, x: Column) -> Column:
        d = x.cast("double") - s["mean"]
        n = s["n"] + 1
        first = s["n"] == 0
        dev = F.when(first | (n <= warmup) | (s["var"] <= 0), 0.0).otherwise(d / F.sqrt(s["var"]))
        mean = F.when(first, x.cast("double")).otherwise(s["mean"] + alpha * d)
        var = F.when(first, 0.0).otherwise((1 - alpha) * (s["var"] + alpha * d * d))
        return F.struct(n.alias("n"), mean.alias("mean"), var.alias("var"), dev.alias("out"))

    return running(xs, start, step)


def clipped_baseline(xs: Column, alpha: float, sigmas: float) -> Column:
    """Deviation of each value from a baseline whose updates are clipped ``sigmas`` deviations above the mean.

    The deviation is (x - mean) / sqrt(max(var, mean, 1)); the baseline starts at mean 0, variance 0."""
    start = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"), F.lit(0.0).alias("out"))

    def step(s: Column, x: Column) -> Column:
        sd = F.sqrt(F.greatest(s["var"], s["mean"], F.lit(1.0)))
        seen = F.least(x.cast("double"), s["mean"] + sigmas * sd)
        d = seen - s["mean"]
        return F.struct((s["mean"] + alpha * d).alias("mean"), ((1 - alpha) * (s["var"] + alpha * d * d)).alias("var"), ((x.cast("double") - s["mean"]) / sd).alias("out"))

    return running(xs, start, step)


def primed_baseline(xs: Column, alpha: float, sigmas: float, warmup: int) -> Column:
    """Deviation of each rate from its key's own moving mean once ``warmup`` rates are known, before that from a prior.

    xs: structs (x, mean, var), the prior at that time.  The deviation is (x - mean) / sqrt(max(var, mean, 1)); a rate of
    ``sigmas`` deviations and more teaches as if it were just there.  The first rate sets the mean."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"), F.lit(0.0).alias("out"))

    def step(s: Column, e: Column) -> Column:
        own = s["n"] >= warmup

        def of(b: Column) -> Column:
            sd = F.sqrt(F.greatest(b["var"], b["mean"], F.lit(1.0)))
            dev = (e["x"] - b["mean"]) / sd
            seen = F.when(dev < sigmas, e["x"]).otherwise(b["mean"] + sigmas * sd)
            d = seen - s["mean"]
            mean = F.when(s["n"] == 0, seen).otherwise(s["mean"] + alpha * d)
            var = F.when(s["n"] == 0, 0.0).otherwise((1 - alpha) * (s["var"] + alpha * d * d))
            return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), var.alias("var"), dev.alias("out"))

        return let(F.struct(F.when(own, s["mean"]).otherwise(e["mean"]).alias("mean"), F.when(own, s["var"]).otherwise(e["var"]).alias("var")), of)

    return running(F.transform(xs, lambda e: F.struct(*[e[c].cast("double").alias(c) for c in ("x", "mean", "var")])), start, step)


def occupied_baseline(xs: Column, warmup: int, alpha: float = 0.1, sigmas: float = 3.0) -> Column:
    """Deviation of each rate from the moving mean of the rates before it; past ``warmup`` rates a rise teaches at most
    ``sigmas`` deviations.  The first rate sets the mean and deviates from 0."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"), F.lit(0.0).alias("out"))

    def step(s: Column, x: Column) -> Column:
        sd = F.sqrt(F.greatest(F.lit(1.0), s["mean"], s["var"]))
        seen = F.when(s["n"] < warmup, x).otherwise(F.least(x, s["mean"] + sigmas * sd))
        d = seen - s["mean"]
        mean = F.when(s["n"] == 0, seen).otherwise(s["mean"] + alpha * d)
        var = F.when(s["n"] == 0, 0.0).otherwise((1 - alpha) * (s["var"] + alpha * d * d))
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), var.alias("var"), ((x - s["mean"]) / sd).alias("out"))

    return running(F.transform(xs, lambda x: x.cast("double")), start, step)


def passes(ts: Column, gap: float) -> Column:
    """Of ordered times, whether each is at least ``gap`` after the last one that passed."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(False).alias("out"))

    def step(s: Column, t: Column) -> Column:
        go = s["last"].isNull() | (t - s["last"] >= gap)
        return F.struct(F.when(go, t).otherwise(s["last"]).alias("last"), go.alias("out"))

    return running(F.transform(ts, lambda t: t.cast("long")), start, step, "boolean")


def ewma_before(xs: Column, alpha: float) -> Column:
    """Moving mean of the values before each value; 0 before the first.  The mean starts at the first value."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("out"))

    def step(s: Column, x: Column) -> Column:
        mean = F.when(s["n"] == 0, x).otherwise(s["mean"] + alpha * (x - s["mean"]))
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), s["mean"].alias("out"))

    return running(F.transform(xs, lambda x: x.cast("double")), start, step)


def ewma_after(xs: Column, alpha: float) -> Column:
    """Moving mean of the values up to each value."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("out"))

    def step(s: Column, x: Column) -> Column:
        mean = F.when(s["n"] == 0, x).otherwise(s["out"] + alpha * (x - s["out"]))
        return F.struct((s["n"] + 1).alias("n"), mean.alias("out"))

    return running(F.transform(xs, lambda x: x.cast("double")), start, step)


def cooldown(ts: Column, gap: float) -> Column:
    """Of ordered times, those at least ``gap`` after the last one that was let through."""
    empty = F.array().cast("array<long>")
    return F.aggregate(ts, empty, lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(a, -1) >= gap), F.concat(a, F.array(t.cast("long")))).otherwise(a))


def quota(ts: Column, window: int, most: int) -> Column:
    """Of ordered times, those with fewer than ``most`` let through in the ``window`` before; 0 sets no limit."""
    empty = F.array().cast("array<long>")
    if not most:
        return F.transform(ts, lambda t: t.cast("long"))
    return F.aggregate(ts, empty, lambda a, t: F.when(F.size(F.filter(F.slice(a, F.greatest(F.size(a) - most + 1, F.lit(1)), most), lambda x: t - x < window)) < most, F.concat(a, F.array(t.cast("long")))).otherwise(a))
