"""Scoring and evaluation over documents and their labels; the score is a rank of the text's length."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowmill.functions import scalar
from flowmill.operators import scoring
from flowmill.plans.registry import query

SCORED = "s AS (SELECT doc_id, lang, least(1.0, n_chars / 5000.0) AS p, quality AS y, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS yhat FROM documents JOIN labels USING (doc_id))"


def scored(t):
    d = t.documents.select("doc_id", "lang", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("yhat"))
    return d.join(t.labels.select("doc_id", F.col("quality").alias("y")), "doc_id")


def weighted(t):
    return scored(t).withColumn("w", F.lit(1.0) + F.col("doc_id") % 3)


@query(f"WITH {SCORED} SELECT y, yhat, count(*) AS n FROM s GROUP BY ALL")
def confusion_counts(t):
    return scored(t).groupBy("y", "yhat").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SCORED}, w AS (SELECT *, 1.0 + doc_id % 3 AS w FROM s), c AS (SELECT k AS cls, sum(CASE WHEN y = k THEN w ELSE 0 END) AS support, sum(CASE WHEN yhat = k THEN w ELSE 0 END) AS called, sum(CASE WHEN y = k AND yhat = k THEN w ELSE 0 END) AS tp FROM w, (VALUES (0), (1)) v(k) GROUP BY k)
SELECT cls, CAST(support AS DOUBLE) AS support, round(tp / called, 6) AS precision, round(tp / support, 6) AS recall, round(2 * (tp / called) * (tp / support) / (tp / called + tp / support), 6) AS f1 FROM c""")
def precision_recall_f1(t):
    f = scoring.weighted_f1(weighted(t), "y", "yhat", "w")
    return f.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""WITH {SCORED}, w AS (SELECT *, 1.0 + doc_id % 3 AS w FROM s), g AS (SELECT lang, p, sum(CASE WHEN y > 0 THEN w ELSE 0 END) AS a, sum(w) AS b FROM w GROUP BY ALL),
c AS (SELECT *, sum(a) OVER (PARTITION BY lang ORDER BY p DESC) AS tp, sum(b) OVER (PARTITION BY lang ORDER BY p DESC) AS n FROM g) SELECT lang, round(sum(a * tp / n) / sum(a), 6) AS ap FROM c GROUP BY lang""")
def pr_auc(t):
    return scoring.average_precision(weighted(t), ["lang"], "y", "p", "w").withColumn("ap", F.round("ap", 6))


RELIABILITY = f"""{SCORED}, w AS (SELECT *, 1.0 + doc_id % 3 AS w FROM s), b AS (SELECT CAST(least(floor(p * 12), 11) AS INT) AS bin, CAST(sum(w) AS DOUBLE) AS weight, sum(p * w) / sum(w) AS mean_p, sum(y * w) / sum(w) AS rate FROM w GROUP BY 1)"""


@query(f"WITH {RELIABILITY} SELECT bin, weight, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM b")
def reliability_bins(t):
    return scoring.reliability(weighted(t), "y", "p", "w").withColumns({"mean_p": F.round("mean_p", 6), "rate": F.round("rate", 6)})


@query(f"WITH {RELIABILITY} SELECT round(sum(abs(mean_p - rate) * weight) / sum(weight), 6) AS ece FROM b")
def reliability_ece(t):
    return scoring.calibration_error(scoring.reliability(weighted(t), "y", "p", "w")).withColumn("ece", F.round("ece", 6))


@query(f"WITH {SCORED}, n AS (SELECT count(*) AS n, sum(y) AS p FROM s) SELECT doc_id, round(CASE WHEN y > 0 THEN n * 0.001 / n.p ELSE n * 0.999 / (n - n.p) END, 8) AS weight FROM s, n")
def prevalence_weights(t):
    return scoring.prevalence_weights(scored(t), "y", 0.001).select("doc_id", F.round("weight", 8).alias("weight"))


@query(f"WITH {SCORED} SELECT doc_id, round(p * (0.001 / 0.5) / (p * (0.001 / 0.5) + (1 - p) * (0.999 / 0.5)), 9) AS shifted FROM s")
def prior_shift(t):
    return scored(t).select("doc_id", F.round(scalar.prior_shift(F.col("p"), 0.5, 0.001), 9).alias("shifted"))


@query(f"WITH {SCORED} SELECT doc_id, round(CASE WHEN p <= 0.1 THEN 0.05 WHEN p < 0.4 THEN 0.05 + (p - 0.1) * (0.45 / 0.3) WHEN p < 0.9 THEN 0.5 + (p - 0.4) * (0.4 / 0.5) ELSE 0.9 END, 6) AS q FROM s")
def calibrate_interp(t):
    return scored(t).select("doc_id", F.round(scalar.interpolate(F.col("p"), [0.1, 0.4, 0.9], [0.05, 0.5, 0.9]), 6).alias("q"))


@query(f"""WITH {SCORED}, e AS (SELECT doc_id, [p, 1 - p, 0.3] AS z FROM s), x AS (SELECT doc_id, list_transform(z, lambda v: exp(v)) AS x FROM e), q AS (SELECT doc_id, x[1] / list_sum(x) AS a, x[2] / list_sum(x) AS b, x[3] / list_sum(x) AS c FROM x)
SELECT doc_id, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS label, round(list_sort([a, b, c])[3] - list_sort([a, b, c])[2], 6) AS lead FROM q""")
def softmax(t):
    q = scored(t).select("doc_id", scalar.softmax(F.array(F.col("p"), 1 - F.col("p"), F.lit(0.3))).alias("q"))
    best = scoring.best_class(F.col("q"), ["a", "b", "c"])
    return q.select("doc_id", *[F.round(F.element_at("q", i + 1), 6).alias(c) for i, c in enumerate("abc")], best["label"].alias("label"), F.round(best["lead"], 6).alias("lead"))


@query(f"WITH {SCORED}, r AS (SELECT p FROM s WHERE doc_id % 3 = 0) SELECT doc_id, round((1 + (SELECT count(*) FROM r WHERE r.p >= s.p)) / ((SELECT count(*) FROM r) + 1), 8) AS tail FROM s WHERE doc_id % 3 <> 0")
def conformal_tail(t):
    s = scored(t)
    return scoring.conformal_tail(s.filter("doc_id % 3 <> 0"), "p", s.filter("doc_id % 3 = 0"), "p").select("doc_id", F.round("tail", 8).alias("tail"))


@query(f"WITH {SCORED}, r AS (SELECT p FROM s WHERE doc_id % 3 = 0) SELECT doc_id, round((SELECT count(*) FROM r WHERE r.p < s.p) / (SELECT count(*) FROM r), 8) AS percentile FROM s WHERE doc_id % 3 <> 0")
def percentile_rank(t):
    s = scored(t)
    return scoring.percentile_rank(s.filter("doc_id % 3 <> 0"), "p", s.filter("doc_id % 3 = 0"), "p").select("doc_id", F.round("percentile", 8).alias("percentile"))


@query("""WITH m AS (SELECT median(c_acctbal) AS m FROM customer), d AS (SELECT median(abs(c_acctbal - m)) * 1.4826 AS s FROM customer, m) SELECT c_custkey, round((c_acctbal - m) / s, 6) AS d FROM customer, m, d""")
def robust_deviation(t):
    return scoring.robust_deviation(t.customer, ["c_acctbal"], t.customer).select("c_custkey", F.round("d_c_acctbal", 6).alias("d"))


@query(f"WITH {SCORED} SELECT CASE WHEN p BETWEEN 0.35 AND 0.85 THEN 'uncertain' WHEN lang = 'de' THEN 'encrypted' ELSE 'none' END AS why, count(*) AS n FROM s GROUP BY 1")
def gate_band(t):
    s = scored(t)
    return s.groupBy(F.coalesce(scoring.gate(F.col("p"), F.col("lang") == "de", F.col("doc_id"), qa=0.0), F.lit("none")).alias("why")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM s)
SELECT lang, CASE WHEN i <= 0.6 * n THEN 'train' WHEN i <= 0.8 * n THEN 'calibration' ELSE 'test' END AS split, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM r GROUP BY ALL""")
def split_counts(t):
    w = Window.partitionBy("lang")
    r = scored(t).withColumn("i", F.row_number().over(w.orderBy("doc_id"))).withColumn("c", F.count(F.lit(1)).over(w))
    split = F.when(F.col("i") <= 0.6 * F.col("c"), "train").when(F.col("i") <= 0.8 * F.col("c"), "calibration").otherwise("test")
    return r.groupBy("lang", split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"))


@query()
def isolation_score(t):
    v = t.embeddings.select("vec_id", *[F.get("embedding", F.lit(i)).alias(f"e{i}") for i in range(6)])
    return scoring.rarity(v, [f"e{i}" for i in range(6)], "vec_id").select("vec_id", F.round("rarity", 6).alias("rarity"))


@query()
def forest_classifier(t):
    s = scored(t).withColumn("f", F.length("lang").cast("double") + F.col("p"))
    model = scoring.fit_classifier(s.filter("doc_id % 5 <> 0"), ["p", "f"], "y", trees=10, depth=4)
    out = model.transform(s.filter("doc_id % 5 = 0"))
    return out.groupBy("y", F.col("prediction").cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query()
def isotonic_calibration(t):
    x, y = scoring.isotonic(scored(t), "p", "y")
    return t.spark.createDataFrame(list(zip(x, y, strict=True)), "x double, y double")


@query(f"WITH {SCORED} SELECT CASE WHEN yhat = 1 THEN 'long' WHEN lang <> 'en' AND p >= 0.1 THEN lang ELSE 'benign' END AS both, count(*) AS n FROM s GROUP BY 1")
def ablation_arms(t):
    s = scored(t).withColumns({"rule": F.when(F.col("yhat") == 1, "long").otherwise("benign"), "model": F.when(F.col("lang") != "en", F.col("lang")).otherwise("benign")})
    return scoring.ablation_arms(s, "rule", "model", "p", least=0.1).groupBy("both").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 100 AS draws, true AS near")
def bootstrap_draws(t):
    s = scored(t)
    d = scoring.bootstrap(s, "doc_id", F.col("y"), 100)
    mean = s.agg(F.avg("y").alias("m"))
    return d.crossJoin(F.broadcast(mean)).agg(F.count(F.lit(1)).cast("int").alias("draws"), (F.abs(F.avg("mean") - F.first("m")) < 0.05).alias("near"))


@query(f"""WITH {SCORED}, w(id, a, b, label) AS (VALUES (1, 0, 200, 1), (2, 100, 600, 0), (3, 100000000, 100000001, 1))
SELECT id, count(doc_id) AS rows, count(*) FILTER (yhat = label) AS fired, min(doc_id) FILTER (yhat = label) AS first FROM w LEFT JOIN s ON doc_id BETWEEN a AND b GROUP BY id""")
def episode_table(t):
    w = t.spark.createDataFrame([(1, 0, 200, 1), (2, 100, 600, 0), (3, 100_000_000, 100_000_001, 1)], "id int, start long, end long, label int")
    return scoring.episodes(w, scored(t).select("doc_id", "yhat"), "label", "yhat", "doc_id", 100).select("id", "rows", "fired", "first")


@query(f"WITH {SCORED}, a AS (SELECT lang, p FROM s WHERE y > 0), b AS (SELECT lang, p FROM s WHERE y = 0) SELECT lang, round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END), 6) AS auroc FROM a JOIN b USING (lang) GROUP BY lang")
def auroc_by_language(t):
    return scoring.auroc(scored(t), ["lang"], "y", "p").withColumn("auroc", F.round("auroc", 6))


@query(f"WITH {SCORED} SELECT lang, count(*) AS positives, round(count(*) FILTER (yhat = 1) / count(*), 6) AS recall FROM s WHERE y > 0 GROUP BY 1")
def family_recall(t):
    return scoring.family_recall(scored(t), "lang", "y", F.col("yhat") == 1).withColumn("recall", F.round("recall", 6))


@query("SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i % greatest(1, CAST(ceil(n / 64) AS BIGINT)) = 0")
def spaced_sample(t):
    return scoring.spaced(t.events, ["value", "event_id"], 64).select("event_id", "value")


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey % 9 = 0 AND c_custkey % 8 <> 0) AS missing, (SELECT count(*) FROM customer WHERE c_custkey % 8 = 0 AND c_custkey % 9 <> 0) AS extra")
def frame_equality(t):
    c = t.customer.select("c_custkey")
    return scoring.same_rows(c, c.filter("c_custkey % 9 <> 0").unionByName(c.filter("c_custkey % 8 = 0")))


@query(f"WITH {SCORED}, f AS (SELECT lang, yhat, round(avg(y), 6) AS rate, count(*) AS n FROM s GROUP BY ALL) SELECT lang, arg_max(yhat, rate * 1000000 + yhat) AS best, max(rate) AS rate FROM f GROUP BY lang")
def best_candidate(t):
    f = scored(t).groupBy("lang", "yhat").agg(F.round(F.avg("y"), 6).alias("rate"), F.count(F.lit(1)).alias("n"))
    return f.groupBy("lang").agg(F.max_by("yhat", F.struct("rate", "yhat")).alias("best"), F.max("rate").alias("rate"))


@query(f"""WITH {SCORED}, e AS (SELECT doc_id, 1 / (1 + exp(-4 * p + 2)) AS a, CASE WHEN p <= 0.1 THEN 0.05 WHEN p < 0.9 THEN 0.05 + (p - 0.1) * (0.85 / 0.8) ELSE 0.9 END AS b, 1 - p AS c FROM s) SELECT doc_id, round(a / (a + b + c), 6) AS a, round(b / (a + b + c), 6) AS b, round(c / (a + b + c), 6) AS c FROM e""")
def calibrate_classes(t):
    q = scored(t).select("doc_id", scoring.calibrated(F.array("p", "p", 1 - F.col("p")), [{"a": -4.0, "b": 2.0}, {"x": [0.1, 0.9], "y": [0.05, 0.9]}, None]).alias("q"))
    return q.select("doc_id", *[F.round(F.element_at("q", k + 1), 6).alias(c) for k, c in enumerate("abc")])


@query("""WITH d AS (SELECT event_id, user_id, event_type, ts, dense_rank() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i FROM events), n AS (SELECT *, max(i) OVER (PARTITION BY event_type) + 1 AS n FROM d),
p AS (SELECT *, CASE WHEN i < greatest(1, CAST(floor(n * 0.78) AS BIGINT)) THEN 'fit' WHEN i >= greatest(2, CAST(floor(n * 0.80) AS BIGINT)) THEN 'validate' ELSE 'embargo' END AS part FROM n)
SELECT event_id, part FROM p WHERE part = 'fit' OR part = 'validate' AND user_id NOT IN (SELECT user_id FROM p WHERE part = 'fit')""")
def temporal_split(t):
    return scoring.purged(scoring.temporal_split(t.events, ["event_type"], "ts"), "user_id").select("event_id", "part")


@query("""WITH s AS (SELECT user_id % 10 AS k, ts, CASE WHEN event_id % 10 < 6 THEN 'train' WHEN event_id % 10 < 8 THEN 'calibration' ELSE 'test' END AS split FROM events WHERE user_id % 10 <> 3 OR event_id % 10 < 8),
g AS (SELECT k, min(ts) FILTER (split = 'calibration') AS lc, min(ts) FILTER (split = 'test') AS lt, max(ts) FILTER (split = 'train') AS ht, max(ts) FILTER (split = 'calibration') AS hc FROM s GROUP BY 1)
SELECT k, CASE WHEN lt IS NULL THEN 'no test' WHEN ht >= lc THEN 'train reaches into calibration' WHEN hc >= lt THEN 'calibration reaches into test' END AS problem FROM g WHERE lt IS NULL OR ht >= lc OR hc >= lt""")
def dataset_invariants(t):
    split = F.when(F.col("event_id") % 10 < 6, "train").when(F.col("event_id") % 10 < 8, "calibration").otherwise("test")
    e = t.events.withColumns({"k": F.col("user_id") % 10, "split": split}).filter("k <> 3 OR split <> 'test'")
    return scoring.invariants(e, "k", "ts", "split")


@query("""SELECT event_type AS run, list_filter([CASE WHEN min(value) < 0.05 THEN 'sustained rate' END, CASE WHEN quantile_cont(value, 0.99) > 90 THEN 'p99 latency' END, CASE WHEN max(value) > 300 THEN 'memory' END, CASE WHEN count(*) < 30 THEN 'duration' END], lambda x: x IS NOT NULL) AS failed FROM events GROUP BY 1""")
def qualification(t):
    r = t.events.select(F.col("event_type").alias("run"), F.col("value").alias("rate"), F.col("value").alias("latency_ms"), F.col("value").alias("rss_mb"), F.lit(1.0).alias("seconds"))
    return scoring.qualification(r, 0.05, 90.0, 300.0, 30.0)


@query(f"""WITH {SCORED}, m AS (SELECT 'first' AS model, y AS t, yhat AS p FROM s WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 UNION ALL SELECT 'second', y, CASE WHEN p > 0.1 THEN 1 ELSE 0 END FROM s WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0),
c AS (SELECT model, k AS cls, count(*) FILTER (t = k) AS s, count(*) FILTER (p = k) AS c, count(*) FILTER (t = k AND p = k) AS h FROM m, (VALUES (0), (1)) v(k) GROUP BY ALL), r AS (SELECT model, cls, CASE WHEN c > 0 THEN h / c ELSE 0.0 END AS precision, CASE WHEN s > 0 THEN h / s ELSE 0.0 END AS recall FROM c)
SELECT model, cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM r""")
def model_comparison(t):
    s = scored(t)
    a, b = s.filter("doc_id % 3 <> 0"), s.filter("doc_id % 5 <> 0").withColumn("yhat", F.when(F.col("p") > 0.1, 1).otherwise(0))
    c = scoring.same_rows_compared(a, b, "doc_id", "y", "yhat")
    return c.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})
