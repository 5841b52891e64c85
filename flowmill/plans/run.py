"""The whole engine over synthetic traffic, and pieces of it over the event table."""

from pyspark.sql import functions as F

from flowmill.functions import scalar
from flowmill.operators import alerts, detectors, engine, stats, windows
from flowmill.plans.registry import query
from flowmill.sources import scenarios
from flowmill.sources.packets import EVENTS_AS_PACKETS_SQL, events_as_packets

P = f"p AS ({EVENTS_AS_PACKETS_SQL})"
SEED = 26


def references(spark):
    """Bigram model, fingerprint reference, zones of wildcards, networks that uploads may go to."""
    names = spark.createDataFrame([(a + b,) for a in scenarios.ORDINARY for b in scenarios.ORDINARY], "name string")
    fingerprints = [(scenarios.CHROME_WINDOWS[0], ["windows"], 1.0, 21), (scenarios.FIREFOX_LINUX[0], ["linux"], 1.0, 14)]
    return {
        "bigrams": stats.bigram_model(names, "name"),
        "ja4_reference": spark.createDataFrame(fingerprints, "ja4 string, expected array<string>, confidence double, support int"),
        "suffixes": ["co.uk"],
        "wildcards": spark.createDataFrame([("cloudfront.net",), ("akamaiedge.net",)], "domain string"),
        "allowlist": spark.createDataFrame([("224.0.0.0/4", [], "multicast", 1), ("255.255.255.255/32", [], "broadcast", 2)], "cidr string, ports array<int>, reason string, rank int"),
    }


def detections(spark, packets):
    return engine.detect(packets, **references(spark))


# no SQL: the traffic is made, not read; tests hold the detections against what was put in
@query()
def engine_run(t):
    """All rules over 110,000 packets with every attack: detections and what was suppressed."""
    d = detections(t.spark, scenarios.corpus(t.spark, SEED).coalesce(t.spark.sparkContext.defaultParallelism).persist())
    return d.select("detector", "threat_class", "subtype", "ts_ns", "flow.src_ip", "flow.dst_ip", "flow.dst_port", "confidence", "severity", F.size("evidence").alias("n_evidence"), "reason")


@query()
def engine_run_ten_hours(t):
    """The same traffic in each of ten hours: 1.1 million packets.  Alerts by hour and rule."""
    one = scenarios.corpus(t.spark, SEED)
    ten = one.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumns({"ts_us": F.col("ts_us") + F.col("hour") * 3_600_000_000, "event_id": F.xxhash64("event_id", "hour")}).drop("hour")
    d = detections(t.spark, ten.coalesce(t.spark.sparkContext.defaultParallelism).persist()).filter("reason IS NULL")
    hour = scalar.whole(F.col("ts_ns") - scenarios.BASE_US * 1000, 3_600_000_000_000)
    return d.groupBy(hour.alias("hour"), "detector", "subtype").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P}, x AS (SELECT event_id, src_ip, ts_us, row_number() OVER (PARTITION BY src_ip ORDER BY event_id) * 3600000000 AS g FROM p) SELECT event_id, max(ts_us - g) OVER (PARTITION BY src_ip ORDER BY event_id ROWS UNBOUNDED PRECEDING) + g AS repaired FROM x")
def min_gap_repair(t):
    return windows.min_gap(events_as_packets(t.events), ["src_ip"], ["event_id"], "ts_us", 3_600_000_000).select("event_id", "repaired")


@query(f"""WITH {P} SELECT CASE event_id % 6 WHEN 0 THEN 'volumetric-ddos' WHEN 1 THEN 'c2-beaconing' WHEN 2 THEN 'dga-dns-tunnelling' WHEN 3 THEN 'encrypted-malware' WHEN 4 THEN 'recon-scanning' ELSE 'data-exfiltration' END AS cls,
count(*) FILTER (CASE event_id % 6 WHEN 0 THEN length > 20 AND (length > 60 OR dst_port >= 80 AND src_ip % 2 = 0) WHEN 1 THEN dst_port >= 3 AND length > 0 WHEN 2 THEN dst_port > 1 AND (src_ip > 1 OR length > 1 AND dst_ip > 0) WHEN 3 THEN dst_port > 0 AND length > 0 AND src_ip % 2 = 0 WHEN 4 THEN length > 1 ELSE length >= 50 AND dst_port > 1 END) AS n FROM p GROUP BY 1""")
def evidence_support(t):
    p = events_as_packets(t.events)
    c = F.col
    names = [x for x in alerts.CLASSES if x not in ("benign", "unknown-suspicious")]
    cls = F.element_at(F.array(*map(F.lit, names)), (c("event_id") % 6 + 1).cast("int"))
    even = F.when(c("src_ip") % 2 == 0, 1.0)
    f = {
        "pps_to_dst_ewma_dev": c("length") - 20, "syn_synack_ratio_1s": F.when(c("length") > 60, 2.0).otherwise(0.0), "udp_packet_share": c("dst_port") / 100, "reflection_service_share": even, "beacon_sample_count": c("dst_port"), "ls_peak_period_s": c("length"),
        "source_query_count_300s": c("dst_port"), "distinct_regdom_300s": c("src_ip"), "subdomain_cardinality": c("length"), "qtype_txt_null_ratio": c("dst_ip"), "tls_version": c("dst_port"), "ja4_observation_count": c("length"), "fingerprint_consistency_score": even,
        "scan_probe_count_60s": c("length"), "outbound_bytes_total": c("length"), "out_in_ratio_ewma": c("dst_port"),
    }
    hit = detectors.supported(c("cls"), f, 50)
    return p.withColumn("cls", cls).groupBy("cls").agg(F.count_if(hit).alias("n"))


@query("SELECT event_id, round(0.5 + 0.5 * (greatest(0, least(1, (value / 7 - 2) / 5)) + greatest(0, least(1, value / 77)) + CASE WHEN value >= 30 THEN 1 ELSE 0 END) / 3, 4) AS confidence FROM events")
def confidence_of_margins(t):
    v = F.col("value")
    return t.events.select("event_id", F.round(scalar.confidence([scalar.margin(v / 7, 2, 5), scalar.margin(v, 0, 77), scalar.margin(v, 30, 0)]), 4).alias("confidence"))
