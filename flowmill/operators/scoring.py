"""Scoring and evaluation: calibration, rarity, gates, metrics, splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import scalar
from flowmill.operators import windows

def weighted_f1(rows: DataFrame, truth: str, predicted: str, weight: str) -> DataFrame:
    """Weighted precision, recall and F1 of each class: one pass, each row under its truth and its prediction."""
    side = F.explode(F.array(F.struct(F.col(truth).alias("cls"), F.lit(1).alias("t"), (F.col(truth) == F.col(predicted)).cast("int").alias("tp")), F.struct(F.col(predicted).alias("cls"), F.lit(0).alias("t"), F.lit(0).alias("tp")))).alias("s")
    c = rows.select(F.col(weight).alias("w"), side).groupBy(F.col("s.cls").alias("cls")).agg(
        F.sum(F.when(F.col("s.t") == 1, F.col("w")).otherwise(0.0)).alias("support"),
        F.sum(F.when(F.col("s.t") == 0, F.col("w")).otherwise(0.0)).alias("called"),
        F.sum(F.col("s.tp") * F.col("w")).alias("tp"),
    )
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = c.withColumns({"precision": safe(F.col("tp"), F.col("called")), "recall": safe(F.col("tp"), F.col("support"))})
    return c.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("called", "tp")


def average_precision(rows: DataFrame, keys: list[str], truth: str, score: str, weight: str) -> DataFrame:
    """Weighted area under precision over recall; equal scores count at once.  Scores are folded to one row each first."""
    s = rows.groupBy(*keys, score).agg(F.sum(F.when(F.col(truth) > 0, F.col(weight)).otherwise(0.0)).alias("_p"), F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc())
    s = s.withColumns({"_tp": F.sum("_p").over(w), "_n": F.sum("_w").over(w)})
    g = s.groupBy(*keys).agg(F.sum(F.col("_p") * F.col("_tp") / F.col("_n")).alias("_a"), F.sum("_p").alias("_t"))
    return g.select(*keys, F.when(F.col("_t") > 0, F.col("_a") / F.col("_t")).otherwise(0.0).alias("ap"))


def reliability(rows: DataFrame, truth: str, p: str, weight: str, bins: int = 12) -> DataFrame:
    """Per bin: weight, mean prediction, rate of the truth."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    g = rows.groupBy(b).agg(F.sum(weight).alias("weight"), F.sum(F.col(p) * F.col(weight)).alias("_p"), F.sum(F.col(truth) * F.col(weight)).alias("_t"))
    return g.select("bin", "weight", (F.col("_p") / F.col("weight")).alias("mean_p"), (F.col("_t") / F.col("weight")).alias("rate"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.abs(F.col("mean_p") - F.col("rate")) * F.col("weight")) / F.sum("weight")).alias("ece"))


def prevalence_weights(rows: DataFrame, truth: str, prevalence: float) -> DataFrame:
    """rows with ``weight`` so that positives make up ``prevalence`` of the whole weight, which is the number of rows."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col(truth) > 0, 1).otherwise(0)).alias("_p"))
    pos, neg = F.col("_n") * prevalence / F.col("_p"), F.col("_n") * (1 - prevalence) / (F.col("_n") - F.col("_p"))
    return rows.crossJoin(F.broadcast(n)).withColumn("weight", F.when(F.col(truth) > 0, pos).otherwise(neg)).drop("_n", "_p")


def conformal_tail(rows: DataFrame, score: str, reference: DataFrame, ref: str) -> DataFrame:
    """rows with ``tail`` = (1 + reference scores >= score) / (n + 1).  Both sides are folded to distinct scores; ranks
    come from one sort, not from a join of every pair."""
    return _ranked(rows, score, reference, ref, lambda n, below: (1 + n - below) / (n + 1), "tail")


def percentile_rank(rows: DataFrame, score: str, reference: DataFrame, ref: str) -> DataFrame:
    """rows with ``percentile``: the share of reference scores below the row's."""
    return _ranked(rows, score, reference, ref, lambda n, below: below / n, "percentile")


def _ranked(rows: DataFrame, score: str, reference: DataFrame, ref: str, value, name: str) -> DataFrame:
    ours = rows.select(F.col(score).alias("_x")).distinct().select("_x", F.lit(0).cast("long").alias("_c"), F.lit(0).alias("_r"))
    theirs = reference.groupBy(F.col(ref).alias("_x")).agg(F.count(F.lit(1)).alias("_c")).select("_x", "_c", F.lit(1).alias("_r"))
    both = windows.prefix_sums(ours.unionByName(theirs), ["_x", "_r"], F.col("_c"), "_b")
    n = theirs.agg(F.sum("_c").alias("_n"))
    ranks = both.filter("_r = 0").crossJoin(F.broadcast(n)).select("_x", value(F.col("_n"), F.col("_b")).alias(name))
    return rows.join(ranks, F.col(score) == F.col("_x")).drop("_x")


def robust_deviation(rows: DataFrame, columns: list[str], reference: DataFrame) -> DataFrame:
    """rows with d_<column>: distance from the reference's median in scaled median absolute deviations."""
    mid = reference.agg(*[F.median(c).alias(f"_m_{c}") for c in columns])
    mad = reference.crossJoin(F.broadcast(mid)).agg(*[(F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))) * 1.4826).alias(f"_s_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(mid)).crossJoin(F.broadcast(mad))
    return out.withColumns({f"d_{c}": F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def gate(p: Column, encrypted: Column, id_: Column, low: float = 0.35, high: float = 0.85, qa: float = 0.005, seed: int = 0) -> Column:
    """Why a row is promoted to review: an uncertain score, an encrypted candidate, or a seeded sample; else null."""
    sampled = F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(1_000_000)) < int(qa * 1_000_000)
    return F.when((p >= low) & (p <= high), "uncertain").when(encrypted, "encrypted").when(sampled, "qa-sample")


def best_class(scores: Column, names: list[str]) -> dict[str, Column]:
    """The class of the largest probability, it, and its lead over the second."""
    ordered = F.sort_array(scores, False)
    label = F.element_at(F.array(*map(F.lit, names)), F.array_position(scores, F.array_max(scores)).cast("int"))
    return {"label": label, "p": F.element_at(ordered, 1), "lead": F.element_at(ordered, 1) - F.element_at(ordered, 2)}


class IsolationForest:
    """Isolation trees over a bounded sample: arrays of (feature, cut, left, right, size)."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], sample: int):
        self.trees, self.norm = trees, self._path(sample)

    @staticmethod
    def _path(n: float) -> float:
        """Mean path of an unsuccessful search among n rows."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 1) -> IsolationForest:
        out, m = [], min(sample, len(x))
        limit = int(np.ceil(np.log2(max(m, 2))))
        for t in range(trees):
            rng = np.random.default_rng((seed, t))
            nodes: list[list[float]] = []

            def grow(rows: np.ndarray, depth: int, rng=rng, nodes=nodes) -> int:
                k = len(nodes)
                nodes.append([-1, 0.0, -1, -1, len(rows)])
                spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
                if depth < limit and len(spread):
                    f = int(rng.choice(spread))
                    cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
                    left = rows[:, f] < cut
                    nodes[k][:4] = [f, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)]
                return k

            grow(x[rng.permutation(len(x))[:m]], 0)
            a = np.array(nodes)
            out.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
        return cls(out, m)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 is rare."""
        total = np.zeros(len(x))
        for f, cut, left, right, size in self.trees:
            at, depth = np.zeros(len(x), int), np.zeros(len(x))
            live = np.flatnonzero(f[at] >= 0)
            while len(live):
                node = at[live]
                at[live] = np.where(x[live, f[node]] < cut[node], left[node], right[node])
                depth[live] += 1
                live = live[f[at[live]] >= 0]
            total += depth + np.array([self._path(s) for s in size])[at]
        return 2.0 ** (-total / len(self.trees) / max(self.norm, 1e-9))


def rarity(rows: DataFrame, columns: list[str], id_: str, sample: int = 4096, trees: int = 100, seed: int = 1) -> DataFrame:
    """rows with ``rarity``, scored by an isolation forest fitted on at most about ``sample`` rows, drawn by the id's hash."""
    n = max(1, rows.count())
    chosen = rows.filter(F.pmod(F.xxhash64(id_), F.lit(1_000_000)) < int(min(1.0, sample / n) * 1_000_000)).orderBy(id_).select(*[F.col(c).cast("double") for c in columns])
    x = np.nan_to_num(chosen.toPandas().to_numpy(float))
    forest = rows.sparkSession.sparkContext.broadcast(IsolationForest.fit(x, trees=trees, seed=seed) if len(x) else IsolationForest([], 1))

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        model = forest.value
        values = np.nan_to_num(np.column_stack([c.to_numpy(float) for c in cols]))
        return pd.Series(model.score(values) if model.trees else np.zeros(len(values)))

    return rows.withColumn("rarity", score(*[F.col(c).cast("double") for c in columns]))


def fit_classifier(train: DataFrame, features: list[str], label: str, trees: int = 40, depth: int = 8, seed: int = 1):
    """A random forest over assembled features; nulls are kept as NaN-safe zeros with indicator columns left to callers."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    assemble = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="keep")
    return Pipeline(stages=[assemble, RandomForestClassifier(featuresCol="_v", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)]).fit(train)


def isotonic(rows: DataFrame, p: str, truth: str, weight: str | None = None) -> tuple[list[float], list[float]]:
    """Break points of the isotonic calibration of a score."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    v = VectorAssembler(inputCols=[p], outputCol="_x").transform(rows.withColumn(truth, F.col(truth).cast("double")))
    fit = IsotonicRegression(featuresCol="_x", labelCol=truth)
    model = (fit.setWeightCol(weight) if weight else fit).fit(v)
    return list(map(float, model.boundaries.toArray())), list(map(float, model.predictions.toArray()))


def ablation_arms(rows: DataFrame, rule: str, model: str, rarity: str, benign: str = "benign", least: float = 0.5) -> DataFrame:
    """rows with the prediction of each arm: rules alone, model alone, both (rule first, then a rare enough model call)."""
    both = F.when(F.col(rule) != benign, F.col(rule)).when((F.col(model) != benign) & (F.col(rarity) >= least), F.col(model)).otherwise(F.lit(benign))
    return rows.withColumns({"rules_only": F.col(rule), "model_only": F.col(model), "both": both})


def bootstrap(rows: DataFrame, id_: str, value: Column, draws: int = 400, seed: int = 0) -> DataFrame:
    """(draw, mean): Poisson bootstrap; a row's weight in a draw comes from the hash of its id, so it is the same anywhere."""
    u = F.pmod(F.xxhash64(F.col(id_), F.col("draw"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    cut = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cut), F.lit(0))
    drawn = rows.select(id_, value.alias("_v"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    return drawn.withColumn("_w", weight).groupBy("draw").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("mean"))


def quality_gates(report: DataFrame, precision: float = 0.95, recall: float = 0.90, least_rows: int = 100) -> DataFrame:
    """Classes of a report (cls, support, precision, recall) that miss a gate, and which."""
    why = F.when(F.col("support") < least_rows, "rows").when(F.col("precision") < precision, "precision").when(F.col("recall") < recall, "recall")
    return report.withColumn("gate", why).filter("gate IS NOT NULL")


def episodes(windows: DataFrame, rows: DataFrame, label: str, fired: str, at: str, cell: int) -> DataFrame:
    """Per labelled window (id, start, end, label): rows in it, rows that fired its label, the first of them."""
    from flowmill.operators.joins import interval_join

    hit = interval_join(rows, windows.withColumnRenamed(label, "_label"), at, "start", "end", cell)
    n = hit.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(fired) == F.col("_label")).alias("fired"), F.min(F.when(F.col(fired) == F.col("_label"), F.col(at))).alias("first"))
    return windows.join(n, "id", "left").na.fill(0, ["rows", "fired"])


def auroc(rows: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by key: the share of (positive, negative) pairs in order, ties half.  From counts by
    distinct score, never from pairs of rows.  A key of one class only has no such pair and no row."""
    c = rows.groupBy(*keys, score).agg(F.sum(F.when(F.col(truth) > 0, 1).otherwise(0)).alias("_p"), F.sum(F.when(F.col(truth) > 0, 0).otherwise(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_b", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    g = c.groupBy(*keys).agg(F.sum(F.col("_p") * (F.col("_b") + F.col("_n") / 2)).alias("_s"), F.sum("_p").alias("_tp"), F.sum("_n").alias("_tn"))
    return g.filter((F.col("_tp") > 0) & (F.col("_tn") > 0)).select(*keys, (F.col("_s") / (F.col("_tp") * F.col("_tn"))).alias("auroc"))


def family_recall(rows: DataFrame, family: str, truth: str, hit: Column) -> DataFrame:
    """(family, positives, recall): share of each family's positives that were called."""
    g = rows.filter(F.col(truth) > 0).groupBy(family).agg(F.count(F.lit(1)).alias("positives"), F.count_if(hit).alias("_h"))
    return g.select(family, "positives", (F.col("_h") / F.col("positives")).alias("recall"))


def spaced(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, evenly spaced in order (its first column a number); a sampling operator."""
    r = windows.prefix_sums(rows, order, F.lit(1), "_i").crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("_n"))))
    return r.filter(F.col("_i") % F.greatest(F.lit(1), F.ceil(F.col("_n") / most)) == 0).drop("_i", "_n")


def calibrated(scores: Column, curves: list[dict | None]) -> Column:
    """An array of class scores, each through its curve, made to add up to one (equal parts where all are zero).  A curve has
    points x and y, or a and b of a sigmoid; None leaves the score."""

    def one(k: int, curve: dict | None) -> Column:
        p = F.get(scores, F.lit(k))
        if curve is None:
            return p.cast("double")
        return 1 / (1 + F.exp(curve["a"] * p + curve["b"])) if "a" in curve else scalar.interpolate(p, curve["x"], curve["y"])

    def norm(q: Column) -> Column:
        total = F.aggregate(q, F.lit(0.0), lambda a, x: a + x)
        return F.transform(q, lambda x: F.when(total > 0, x / total).otherwise(1.0 / len(curves)))

    return scalar.let(F.array(*[one(k, c) for k, c in enumerate(curves)]), norm)


def temporal_split(rows: DataFrame, keys: list[str], ts: str, fit: float = 0.78, validate: float = 0.80) -> DataFrame:
    """rows with ``part``: fit, embargo or validate, by the place of the row's time among the key's distinct times."""
    w = Window.partitionBy(*keys)
    place = (F.dense_rank().over(w.orderBy(ts)) - 1).cast("long")
    r = rows.withColumn("_place", place)
    n = F.max("_place").over(w) + 1
    edge = lambda share, least: F.greatest(F.lit(least), F.floor(n * share))
    return r.withColumn("part", F.when(F.col("_place") < edge(fit, 1), "fit").when(F.col("_place") >= edge(validate, 2), "validate").otherwise("embargo")).drop("_place")


def purged(parted: DataFrame, flow: str) -> DataFrame:
    """``temporal_split`` rows without validation rows of a flow that was fitted, and without the embargo."""
    seen = parted.filter("part = 'fit'").select(flow).distinct()
    kept = parted.filter("part = 'validate'").join(seen, flow, "left_anti")
    return parted.filter("part = 'fit'").unionByName(kept)


def invariants(rows: DataFrame, key: str, ts: str, split: str, order: tuple[str, ...] = ("train", "calibration", "test")) -> DataFrame:
    """(key, problem): scenarios whose splits overlap in time or lack one."""
    g = rows.groupBy(key).agg(*[F.min(F.when(F.col(split) == s, F.col(ts))).alias(f"lo_{s}") for s in order], *[F.max(F.when(F.col(split) == s, F.col(ts))).alias(f"hi_{s}") for s in order])
    lacks = [F.when(F.col(f"lo_{s}").isNull(), f"no {s}") for s in order]
    late = [F.when(F.col(f"hi_{a}") >= F.col(f"lo_{b}"), f"{a} reaches into {b}") for a, b in zip(order[:-1], order[1:], strict=True)]
    return g.select(key, F.coalesce(*lacks, *late).alias("problem")).filter("problem IS NOT NULL")


def qualification(rates: DataFrame, least_rate: float = 3000.0, most_p99_ms: float = 50.0, most_rss_mb: float = 512.0, least_s: float = 30.0) -> DataFrame:
    """(run, failed): the limits that a run's buckets (run, rate, latency_ms, rss_mb, seconds) miss."""
    g = rates.groupBy("run").agg(F.min("rate").alias("rate"), F.percentile("latency_ms", 0.99).alias("p99"), F.max("rss_mb").alias("rss"), F.sum("seconds").alias("s"))
    tests = [F.when(F.col("rate") < least_rate, "sustained rate"), F.when(F.col("p99") > most_p99_ms, "p99 latency"), F.when(F.col("rss") > most_rss_mb, "memory"), F.when(F.col("s") < least_s, "duration")]
    return g.select("run", F.filter(F.array(*tests), lambda x: x.isNotNull()).alias("failed"))


def same_rows_compared(a: DataFrame, b: DataFrame, id_: str, truth: str, predicted: str) -> DataFrame:
    """(model, cls, precision, recall, f1) of two models on the rows that both have scored."""
    ids = a.select(id_).intersect(b.select(id_))
    both = [m.join(ids, id_, "left_semi").select(F.lit(name).alias("model"), F.col(truth).alias("t"), F.col(predicted).alias("p")) for name, m in (("first", a), ("second", b))]
    rows = both[0].unionByName(both[1])
    side = F.explode(F.array(F.struct(F.col("t").alias("cls"), F.lit(1).alias("s"), F.lit(0).alias("c")), F.struct(F.col("p").alias("cls"), F.lit(0).alias("s"), F.lit(1).alias("c")))).alias("e")
    hit = (F.col("t") == F.col("p")).cast("int")
    g = rows.select("model", hit.alias("hit"), side).groupBy("model", F.col("e.cls").alias("cls")).agg(F.sum("e.s").alias("s"), F.sum("e.c").alias("c"), F.sum(F.col("hit") * F.col("e.s")).alias("h"))
    part = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    g = g.withColumns({"precision": part(F.col("h"), F.col("c")), "recall": part(F.col("h"), F.col("s"))})
    return g.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("s", "c", "h")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(missing, extra): rows of a that b lacks, counted with repeats, and the other way."""
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("missing")).crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("extra")))
