"""Alerts built from events, their checks, the hash chain, the store's queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowmill.functions import scalar
from flowmill.operators import alerts
from flowmill.plans.registry import query

CLASS = "CASE event_id % 8 WHEN 0 THEN 'benign' WHEN 1 THEN 'volumetric-ddos' WHEN 2 THEN 'c2-beaconing' WHEN 3 THEN 'dga-dns-tunnelling' WHEN 4 THEN 'encrypted-malware' WHEN 5 THEN 'recon-scanning' WHEN 6 THEN 'data-exfiltration' ELSE 'unknown-suspicious' END"


def detections(t):
    c = F.col
    cls = F.element_at(F.array(*map(F.lit, alerts.CLASSES)), (c("event_id") % 8 + 1).cast("int"))
    evidence = F.array(*[F.struct(F.lit(n).alias("feature"), c("value").alias("value"), ((c("event_id") * k % 17 - 8) / 10.0).alias("contribution")) for n, k in (("a", 3), ("b", 5), ("c", 7), ("d", 11), ("e", 13), ("f", 2))])
    return t.events.select(
        "event_id",
        (F.unix_micros(c("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        cls.alias("threat_class"),
        c("event_type").alias("subtype"),
        (c("value") / 100).alias("confidence"),
        F.when(c("event_id") % 3 == 0, "high").alias("severity"),
        F.lit("rule").alias("source"),
        c("user_id").cast("string").alias("flow_id"),
        F.lit("TCP").alias("proto"),
        F.lit("10.0.0.1").alias("src_ip"),
        F.concat(F.lit("10.0.1."), (c("user_id") % 250).cast("string")).alias("dst_ip"),
        F.lit(443).alias("dst_port"),
        evidence.alias("evidence"),
        (c("event_id") % 1000 * 12_345).alias("latency_ns"),
    )


@query(f"""WITH d AS (SELECT event_id, epoch_us(ts) AS us, {CLASS} AS cls, event_type, value, user_id, sha1(unhex('1e4a6f601c5f4a0c9a372b5f0e26145a') || encode({CLASS} || '|' || event_type || '|' || (epoch_us(ts) * 1000) || '|' || user_id || '|rule')) AS h,
 CAST(greatest(0, least(100, round_even(CASE WHEN value / 100 <= 1 THEN value / 100 * 100.0 ELSE value / 100 END, 0))) AS INT) AS score FROM events)
SELECT 'indicator--' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) & 3 AS INT) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id,
 strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created, score AS confidence, cls AS x_threat_class, CASE WHEN event_id % 3 = 0 THEN 'HIGH' WHEN score >= 90 THEN 'CRITICAL' WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS x_severity,
 '[network-traffic:protocols[*] = ''tcp'' AND network-traffic:dst_ref.value = ''10.0.1.' || (user_id % 250) || ''' AND network-traffic:dst_port = 443]' AS pattern, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS window_end, user_id || '' AS flow_id, round(event_id % 1000 * 12345 / 1e6, 3) AS x_latency_ms, 'none' AS model_hash FROM d""")
def build_alert(t):
    return alerts.build(detections(t)).select("id", "created", "confidence", "x_threat_class", "x_severity", "pattern", "x_flow_identifier.window_end", "x_flow_identifier.flow_id", "x_latency_ms", "x_model_lineage.model_hash")


BROKEN = ("type", "type", "id", "confidence", "class", "severity", "latency", "flow", "direction", "lineage", "evidence", "evidence", "chain", "technique")


def broken(t):
    """Alerts of which the event's number says what is broken; two in sixteen are whole."""
    k, c = F.col("k"), F.col
    d = detections(t)
    a = alerts.build(d.withColumn("source", c("event_id").cast("string")))
    a = a.withColumn("k", c("x_detector").cast("long") % 16)
    flow = c("x_flow_identifier").withField("src_port", F.when(k != 7, c("x_flow_identifier.src_port"))).withField("directionality", F.when(k == 8, "UP").otherwise(c("x_flow_identifier.directionality")))
    evidence = F.when(k == 10, F.slice("x_supporting_evidence", 1, 0)).when(k == 11, F.transform("x_supporting_evidence", lambda e: e.withField("value", F.lit(float("nan"))))).otherwise(c("x_supporting_evidence"))
    put = lambda name, n, bad: F.when(k == n, bad).otherwise(c(name))
    return a.withColumns(
        {
            "type": put("type", 0, "x"), "spec_version": put("spec_version", 1, "2.0"), "id": put("id", 2, "x"), "confidence": put("confidence", 3, 101), "x_threat_class": put("x_threat_class", 4, "odd"), "x_severity": put("x_severity", 5, "NONE"),
            "x_latency_ms": put("x_latency_ms", 6, -1.0), "x_flow_identifier": flow, "x_model_lineage": c("x_model_lineage").withField("model_id", put("x_model_lineage.model_id", 9, "")), "x_supporting_evidence": evidence, "x_prev_hash": put("x_prev_hash", 12, "sha256:0"),
            "external_references": F.when(k != 13, c("external_references")).otherwise(F.slice("external_references", 1, 0)),
        }
    ).drop("k")


@query("WITH b AS (SELECT list_value(" + ", ".join(f"'{x}'" for x in BROKEN) + ") AS b) SELECT coalesce(b[event_id % 16 + 1], 'none') AS problem, count(*) AS n FROM events, b GROUP BY 1")
def validate_alert(t):
    return alerts.problems(broken(t)).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'none' AS problem, count(*) AS n FROM events")
def validate_whole_alerts(t):
    return alerts.problems(alerts.build(detections(t))).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT event_id, f.n AS feature, ((event_id * f.k % 17) - 8) / 10.0 AS c FROM events, (VALUES ('a', 3), ('b', 5), ('c', 7), ('d', 11), ('e', 13), ('f', 2)) f(n, k)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(c) DESC, feature) AS rn FROM e) SELECT event_id, string_agg(feature, ',' ORDER BY rn) AS top FROM r WHERE rn <= 5 GROUP BY 1""")
def evidence_rank(t):
    return detections(t).select("event_id", F.array_join(F.transform(alerts.top_evidence(F.col("evidence")), lambda e: e["feature"]), ",").alias("top"))


@query(f"SELECT {CLASS} AS cls, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE value >= 40 GROUP BY 1")
def class_counts(t):
    return detections(t).filter("confidence * 100 >= 40").groupBy(F.col("threat_class").alias("cls")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT CASE WHEN value / 100 < 0.6 THEN 'LOW' WHEN value / 100 < 0.75 THEN 'MEDIUM' WHEN value / 100 < 0.9 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, count(*) AS n FROM events GROUP BY 1")
def severity_counts(t):
    return t.events.groupBy(scalar.severity(F.col("value") / 100).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


LEDGER = """l AS (SELECT o_orderkey AS pos, o_orderstatus || '|' || o_orderkey AS record, CASE WHEN o_orderkey = 0 THEN 'sha256:' || repeat('0', 64) ELSE 'sha256:' || sha256((o_orderkey - 1) || '') END AS prev_hash FROM orders)"""


@query(f"WITH {LEDGER} SELECT count(*) AS records, CAST(1 AS BIGINT) AS broken_at, 'link' AS reason FROM l")
def ledger_verify(t):
    o = t.orders
    prev = F.when(F.col("o_orderkey") == 0, alerts.GENESIS).otherwise(F.concat(F.lit("sha256:"), F.sha2((F.col("o_orderkey") - 1).cast("string"), 256)))
    l = o.select(F.col("o_orderkey").alias("pos"), F.concat_ws("|", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("record"), prev.alias("prev_hash"))
    return alerts.verify_chain(l.withColumn("hash", scalar.chain_hash(F.col("record"), F.col("prev_hash"))))


@query("SELECT id, min(seq) AS seq FROM (SELECT 'a' || (event_id % 700) AS id, event_id AS seq FROM events) GROUP BY 1")
def alert_dedupe(t):
    return alerts.dedupe(t.events.select(F.concat(F.lit("a"), (F.col("event_id") % 700).cast("string")).alias("id"), F.col("event_id").alias("seq")))


@query("""SELECT CASE WHEN event_id % 50 = 0 OR event_id % 7 = 0 THEN 'failed' WHEN event_id % 11 = 0 THEN 'untrusted' WHEN event_id >= 9000 THEN 'unanchored' ELSE 'verified' END AS state, count(*) AS n FROM events GROUP BY 1""")
def integrity_state(t):
    e = t.events.select(F.when(F.col("event_id") % 50 != 0, "h").alias("ledger_hash"), (F.col("event_id") % 7 != 0).alias("chain_ok"), (F.col("event_id") % 11 != 0).alias("trusted"), F.col("event_id").alias("pos"), F.lit(9000).alias("anchored"))
    return e.groupBy(alerts.integrity(e).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, CAST(version AS BIGINT) AS version, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE back = 1")
def case_latest_version(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    v = t.events.withColumn("version", F.row_number().over(w))
    last = v.groupBy("user_id").agg(F.max_by(F.struct("event_id", "version", "event_type"), "version").alias("r"))
    return last.select("r.event_id", "user_id", F.col("r.version").cast("long").alias("version"), F.col("r.event_type").alias("status"))


@query("SELECT round(sum(false_alarms) / (sum(seconds) / 3600.0), 6) AS per_hour FROM (SELECT count(*) FILTER (value > 95) AS false_alarms, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY user_id)")
def false_alerts_per_hour(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = t.events.groupBy("user_id").agg(F.count_if(F.col("value") > 95).alias("n"), ((F.max(us) - F.min(us)) / 1e6).alias("s"))
    return g.agg(F.round(F.sum("n") / (F.sum("s") / 3600.0), 6).alias("per_hour"))


# a third of a whole number of cents is no tie of one or two decimals, where printers differ
@query("""SELECT event_id, 'Seen (bytes sent for each received: ' || printf('%.1f', round(value, 2) / 3 + 0.001) || '; something else: ' || printf('%.2f', round(value, 2) / 3 + 0.001) || '; probes refused: ' || printf('%.0f', (event_id % 7) / 8 * 100 + 0.1) || ' %).' ||
CASE WHEN event_id % 4 = 0 THEN ' Load shedding (drop-metrics) left some evidence out.' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN ' Numbers are scaled up from 25 of 100 packets.' ELSE '' END AS text FROM events""")
def explain_text(t):
    from flowmill.operators import explain

    third = F.round("value", 2) / 3 + 0.001
    ev = F.array(*[F.struct(F.lit(name).alias("feature"), v.alias("value")) for name, v in (("out_in_byte_ratio", third), ("something_else", third), ("rst_response_ratio", F.col("event_id") % 7 / 8 + 0.001))])
    tier = explain.shedding_tier(F.when(F.col("event_id") % 4 == 0, 60).otherwise(0), 50, 100)
    ratio = F.when(F.col("event_id") % 5 == 0, 0.25).otherwise(1.0)
    return t.events.select("event_id", explain.summary(ev, F.lit("Seen"), tier, ratio).alias("text"))


CHAIN = """l AS (SELECT o_orderkey AS pos, 'sha256:' || sha256(o_orderstatus || '|' || o_orderkey) AS hash FROM orders)"""


def chain(t):
    return t.orders.select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", "o_orderstatus", F.col("o_orderkey").cast("string")), 256)).alias("hash"))


@query(f"WITH {CHAIN} SELECT count(*) AS records, arg_max(hash, pos) AS head FROM l")
def ledger_head(t):
    return alerts.ledger_head(chain(t))


@query(f"WITH {CHAIN} SELECT pos + 1 AS count, 'differs' AS state FROM l WHERE pos + 1 = 200 UNION ALL SELECT pos + 1, 'beyond the ledger' FROM l WHERE (pos + 1) % 100 = 0 AND pos >= 950")
def ledger_anchors(t):
    l = chain(t)
    a = alerts.anchors(l).withColumn("chain_head", F.when(F.col("count") == 200, "x").otherwise(F.col("chain_head")))
    return alerts.check_anchors(a, l.filter("pos < 950"))
