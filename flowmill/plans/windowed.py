"""Event-time windows and ordered folds."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowmill.functions import folds
from flowmill.operators import detectors, flows, windows
from flowmill.plans.registry import query
from flowmill.sources.packets import EVENTS_AS_PACKETS_SQL, events_as_packets

P = f"p AS ({EVENTS_AS_PACKETS_SQL})"
HOUR, DAY = 3_600_000_000, 86_400_000_000


def _p(t):
    return events_as_packets(t.events)


@query(f"WITH {P} SELECT src_ip, ts_us // {DAY} AS bucket, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes, sum(CASE WHEN tcp_flags = 2 THEN 1 ELSE 0 END) AS syn FROM p GROUP BY 1, 2")
def tumbling_counts(t):
    return windows.tumbling(_p(t), ["src_ip"], "ts_us", DAY, F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.sum((F.col("tcp_flags") == 2).cast("int")).alias("syn"))


@query(f"WITH {P} SELECT dst_ip, ts_us // {6 * HOUR} - k AS start, count(*) AS n FROM p, range(4) r(k) GROUP BY ALL")
def sliding_counts(t):
    return windows.sliding(_p(t), ["dst_ip"], "ts_us", DAY, 6 * HOUR, F.count(F.lit(1)).alias("n"))


@query(f"""WITH {P}, g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w >= {2 * HOUR} THEN 1 ELSE 0 END AS o FROM p WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us)),
s AS (SELECT *, sum(o) OVER (PARTITION BY src_ip ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT src_ip, CAST(session AS BIGINT) AS session, count(*) AS n, max(ts_us) - min(ts_us) AS span FROM s GROUP BY ALL""")
def session_idle(t):
    return windows.sessions(_p(t), ["src_ip"], "ts_us", 2 * HOUR, F.count(F.lit(1)).alias("n"), (F.max("ts_us") - F.min("ts_us")).alias("span"))


@query(f"""WITH {P} SELECT count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT src_ip, s, count(*) AS n FROM (SELECT src_ip, sum(o) OVER (PARTITION BY src_ip ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, event_id) >= {2 * HOUR} THEN 1 ELSE 0 END AS o FROM p)) GROUP BY ALL)""")
def session_window_builtin(t):
    s = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


@query(f"""WITH {P}, c AS (SELECT src_ip, ts_us // {DAY} AS bucket, count(DISTINCT dst_port) AS n FROM p GROUP BY ALL)
SELECT src_ip, bucket, n, greatest(n, CASE WHEN bucket - lag(bucket) OVER w = 1 THEN lag(n) OVER w ELSE 0 END) AS two FROM c WINDOW w AS (PARTITION BY src_ip ORDER BY bucket)""")
def two_gen_distinct(t):
    c = windows.tumbling(_p(t), ["src_ip"], "ts_us", DAY, F.count_distinct("dst_port").alias("n"))
    return c.withColumn("two", windows.two_generations(c, ["src_ip"], "n"))


@query(f"""WITH {P}, g AS (SELECT src_ip, (ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, event_id)) / 1e6 AS x FROM p),
m AS (SELECT src_ip, avg(x) AS mu, stddev_pop(x) AS sd FROM g GROUP BY 1)
SELECT g.src_ip, round(avg(x), 3) AS mean, round(stddev_pop(x), 3) AS std, round(avg(pow(x - mu, 3)) / pow(any_value(sd), 3), 3) AS skew, round(avg(pow(x - mu, 4)) / pow(any_value(sd), 4) - 3, 3) AS kurt, round(min(x), 3) AS least, round(max(x), 3) AS most
FROM g JOIN m USING (src_ip) GROUP BY 1""")
def interarrival_moments(t):
    g = windows.gaps(_p(t), ["src_ip"], "ts_us", "event_id")
    return g.groupBy("src_ip").agg(*[F.round(v, 3).alias(k) for k, v in windows.moments(F.col("gap") / 1e6).items()])


@query(f"WITH {P} SELECT event_id, round(avg(length) OVER w, 4) AS mean64, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us, event_id ROWS 63 PRECEDING)")
def rolling_ring_64(t):
    p = _p(t)
    w = windows.ring(p, ["src_ip"], ["ts_us", "event_id"], 64)
    return p.select("event_id", F.round(F.avg("length").over(w), 4).alias("mean64"), F.count(F.lit(1)).over(w).alias("n"))


@query(f"WITH {P} SELECT event_id, CAST(sum(length) OVER w AS BIGINT) AS total, max(length) OVER w AS peak FROM p WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)")
def running_totals(t):
    w = windows.running(["src_ip"], ["ts_us", "event_id"])
    return _p(t).select("event_id", F.sum("length").over(w).alias("total"), F.max("length").over(w).alias("peak"))


@query(f"""WITH {P}, i AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, event_id) - row_number() OVER (PARTITION BY src_ip, tcp_flags ORDER BY ts_us, event_id) AS g FROM p)
SELECT event_id, row_number() OVER (PARTITION BY src_ip, tcp_flags, g ORDER BY ts_us, event_id) AS run FROM i""")
def run_length_repeat(t):
    return windows.repeats(_p(t), ["src_ip"], ["ts_us", "event_id"], "tcp_flags").select("event_id", F.col("run").cast("long").alias("run"))


@query(f"""WITH {P}, r AS (SELECT *, CASE WHEN tcp_flags IN (2, 16) THEN length ELSE -length END AS s, row_number() OVER w AS rn, ts_us - lag(ts_us) OVER w AS gap FROM p WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us, event_id)),
d AS (SELECT *, CASE WHEN sign(s) <> sign(lag(s) OVER (PARTITION BY src_ip ORDER BY ts_us, event_id)) THEN 1 ELSE 0 END AS turn FROM r)
SELECT src_ip, count(*) AS splt_len, round(avg(abs(s)), 3) AS splt_mean_abs_len, round(CASE WHEN avg(abs(s)) <> 0 THEN stddev_pop(abs(s)) / avg(abs(s)) ELSE 0 END, 4) AS splt_len_cv, round(avg(gap), 0) AS splt_iat_mean,
 round(stddev_pop(gap) / avg(gap), 4) AS splt_iat_cv, round(CASE WHEN sum(CASE WHEN s < 0 THEN -s ELSE 0 END) > 0 THEN sum(CASE WHEN s > 0 THEN s ELSE 0 END) / sum(CASE WHEN s < 0 THEN -s ELSE 0 END) ELSE sum(CASE WHEN s > 0 THEN s ELSE 0 END) END, 4) AS splt_up_down_ratio,
 CAST(sum(turn) AS BIGINT) AS splt_direction_changes FROM d WHERE rn <= 20 GROUP BY 1""")
def first_n_sequence(t):
    signed = F.when(F.col("tcp_flags").isin(2, 16), F.col("length")).otherwise(-F.col("length"))
    f = flows.sequence_features(_p(t), ["src_ip"], ["ts_us", "event_id"], signed)
    return f.withColumns({"splt_mean_abs_len": F.round("splt_mean_abs_len", 3), "splt_len_cv": F.round("splt_len_cv", 4), "splt_iat_mean": F.round("splt_iat_mean", 0), "splt_iat_cv": F.round("splt_iat_cv", 4), "splt_up_down_ratio": F.round("splt_up_down_ratio", 4)})


@query(f"""WITH {P}, f AS (SELECT event_id, (ts_us - min(ts_us) OVER w) / (max(ts_us) OVER w - min(ts_us) OVER w) AS x FROM p WINDOW w AS (PARTITION BY src_ip))
SELECT event_id, round(coalesce(x, 0), 6) AS fraction, CASE WHEN coalesce(x, 0) < 0.42 THEN 'train' WHEN x < 0.45 THEN 'embargo' WHEN x < 0.53 THEN 'calibration' WHEN x < 0.56 THEN 'embargo' ELSE 'test' END AS split FROM f""")
def timeline_split(t):
    return windows.timeline(_p(t), ["src_ip"], "ts_us").select("event_id", F.round("fraction", 6).alias("fraction"), "split")


@query(f"""WITH {P}, r AS (SELECT src_ip, length AS x, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, event_id) AS i, count(*) OVER (PARTITION BY src_ip) AS n FROM p)
SELECT src_ip, round(sum(CASE WHEN i = 1 THEN pow(0.8, n - 1) * x ELSE 0.2 * pow(0.8, n - i) * x END), 4) AS mean FROM r GROUP BY 1""")
def ewma_mean(t):
    g = _p(t).groupBy("src_ip").agg(folds.ordered(F.struct("ts_us", "event_id"), F.col("length")).alias("a"))
    return g.select("src_ip", F.round(folds.ewma(F.transform("a", lambda x: x["v0"]), 0.2), 4).alias("mean"))


DAYS = f"d AS (SELECT src_ip, ts_us // {DAY} AS bucket, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY bucket) AS i FROM d)"


def _days(t):
    return windows.tumbling(_p(t), ["src_ip"], "ts_us", DAY, F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {P}, {DAYS}, r AS (
SELECT src_ip, bucket, i, n AS mean, CAST(0 AS DOUBLE) AS var, CAST(0 AS DOUBLE) AS dev FROM o WHERE i = 1
UNION ALL SELECT o.src_ip, o.bucket, o.i, r.mean + 0.1 * (o.n - r.mean), 0.9 * (r.var + 0.1 * pow(o.n - r.mean, 2)), CASE WHEN o.i <= 5 OR r.var <= 0 THEN 0 ELSE (o.n - r.mean) / sqrt(r.var) END FROM r JOIN o ON o.src_ip = r.src_ip AND o.i = r.i + 1)
SELECT src_ip, bucket, round(dev, 4) AS dev FROM r""")
def ewma_var_dev(t):
    g = _days(t).groupBy("src_ip").agg(folds.ordered(F.col("bucket"), F.col("n")).alias("a"))
    g = g.withColumn("d", folds.ewma_deviation(F.transform("a", lambda x: x["v0"]), 0.1, 5))
    return g.select("src_ip", F.explode(F.arrays_zip("a", "d")).alias("z")).select("src_ip", F.col("z.a.t").alias("bucket"), F.round("z.d", 4).alias("dev"))


BASELINE = f"""WITH RECURSIVE {P}, {DAYS}, r AS (
SELECT src_ip, bucket, i, n, 0.1 * least(n, 4.0) AS mean, 0.9 * 0.1 * pow(least(n, 4.0), 2) AS var, n AS dev FROM o WHERE i = 1
UNION ALL SELECT o.src_ip, o.bucket, o.i, o.n, r.mean + 0.1 * (least(o.n, r.mean + 4 * sqrt(greatest(r.var, r.mean, 1))) - r.mean), 0.9 * (r.var + 0.1 * pow(least(o.n, r.mean + 4 * sqrt(greatest(r.var, r.mean, 1))) - r.mean, 2)),
 (o.n - r.mean) / sqrt(greatest(r.var, r.mean, 1)) FROM r JOIN o ON o.src_ip = r.src_ip AND o.i = r.i + 1)"""


@query(f"{BASELINE} SELECT src_ip, bucket, CAST(n AS BIGINT) AS n, round(dev, 4) AS deviation FROM r")
def clipped_baseline(t):
    return detectors.with_baseline(_days(t), ["src_ip"], "bucket", "n").withColumn("deviation", F.round("deviation", 4))


@query(f"""WITH RECURSIVE {P}, x AS (SELECT src_ip, ts_us FROM p WHERE tcp_flags = 4), r AS (
SELECT src_ip, min(ts_us) AS ts_us FROM x GROUP BY 1 UNION ALL
SELECT src_ip, ts_us FROM (SELECT x.src_ip, min(x.ts_us) AS ts_us FROM r JOIN x ON x.src_ip = r.src_ip AND x.ts_us >= r.ts_us + {2 * DAY} GROUP BY x.src_ip, r.ts_us)) SELECT src_ip, ts_us FROM r""")
def cooldown_emit(t):
    return detectors.cooled(_p(t).filter("tcp_flags = 4"), ["src_ip"], "ts_us", 2 * DAY)


def quota_window(t):
    g = _p(t).groupBy("tcp_flags").agg(F.array_sort(F.collect_set("ts_us")).alias("a"))
    return g.select("tcp_flags", F.explode(folds.quota(F.col("a"), DAY, 3)).alias("ts_us"))


# no SQL: a row's place in the quota depends on all choices before it; tests hold it against plain Python
query()(quota_window)


@query(f"""WITH {P}, c AS (SELECT src_ip, ts_us // {DAY} AS bucket, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 3),
g AS (SELECT *, CASE WHEN bucket - lag(bucket) OVER (PARTITION BY src_ip ORDER BY bucket) > 2 THEN 1 ELSE 0 END AS o FROM c), h AS (SELECT *, sum(o) OVER (PARTITION BY src_ip ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT src_ip, bucket, n, row_number() OVER (PARTITION BY src_ip, s ORDER BY bucket) AS in_a_row FROM h""")
def persistence_count(t):
    return detectors.persistence(_days(t).filter("n >= 3"), ["src_ip"], 2).withColumn("in_a_row", F.col("in_a_row").cast("long"))


@query(f"""WITH {P} SELECT event_id, greatest(ts_us, max(ts_us) OVER (PARTITION BY src_ip ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS clamped FROM p""")
def monotonic_clamp(t):
    w = Window.partitionBy("src_ip").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _p(t).select("event_id", F.max("ts_us").over(w).alias("clamped"))


@query(f"WITH {P} SELECT event_id, count(*) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS rate FROM p")
def sliding_rate(t):
    w = Window.partitionBy("src_ip").orderBy("ts_us").rangeBetween(-DAY, 0)
    return _p(t).select("event_id", F.count(F.lit(1)).over(w).alias("rate"))


@query(f"WITH {P}, c AS (SELECT dst_ip, ts_us // {DAY} AS bucket, src_ip, count(*) AS n FROM p GROUP BY ALL) SELECT dst_ip, bucket, round(max(n) / sum(n), 6) AS share, count(*) AS sources FROM c GROUP BY ALL")
def top_source_share(t):
    c = windows.tumbling(_p(t), ["dst_ip", "src_ip"], "ts_us", DAY, F.count(F.lit(1)).alias("n"))
    return c.groupBy("dst_ip", "bucket").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"), F.count(F.lit(1)).alias("sources"))


@query(f"WITH {P}, b AS (SELECT src_ip, w, ts_us // (w * {DAY}) AS bucket, count(DISTINCT dst_port) AS ports, count(DISTINCT dst_ip) AS hosts FROM p, (VALUES (1), (7), (28)) v(w) GROUP BY ALL) SELECT src_ip, w, max(ports) AS ports, max(hosts) AS hosts FROM b GROUP BY ALL")
def distinct_multi_scale(t):
    scales = F.explode(F.array(*map(F.lit, (1, 7, 28)))).alias("w")
    p = _p(t).select("src_ip", "ts_us", "dst_port", "dst_ip", scales)
    b = p.groupBy("src_ip", "w", F.floor(F.col("ts_us") / (F.col("w") * DAY)).alias("bucket")).agg(F.count_distinct("dst_port").alias("ports"), F.count_distinct("dst_ip").alias("hosts"))
    return b.groupBy("src_ip", "w").agg(F.max("ports").alias("ports"), F.max("hosts").alias("hosts"))
