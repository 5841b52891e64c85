"""Alerts: documents, checks, the hash chain, the store's queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import scalar
from flowmill.operators import explain

# Fixed values.
GENESIS = "sha256:" + "0" * 64
ID_NAMESPACE = "1e4a6f601c5f4a0c9a372b5f0e26145a"
CLASSES = (*scalar.ATTACK_CLASSES, "unknown-suspicious")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
DIRECTIONS = ("FWD_ONLY", "REV_ONLY", "BIDIRECTIONAL", "UNKNOWN")
HEADLINES = {
    "volumetric-ddos": "Suspected volumetric attack",
    "c2-beaconing": "Suspected command-and-control beaconing",
    "dga-dns-tunnelling": "Suspected algorithmic names or DNS tunnelling",
    "encrypted-malware": "Suspected malware in encrypted traffic",
    "recon-scanning": "Suspected reconnaissance scanning",
    "data-exfiltration": "Suspected data exfiltration",
}
MOST_EVIDENCE = 5
LINEAGE = ("model_id", "model_hash", "dataset_version")
FLOW_FIELDS = ("flow_id", "proto", "src_ip", "dst_ip", "src_port", "dst_port", "directionality", "completeness_flag", "window_start", "window_end")
REQUIRED = (
    "type", "spec_version", "id", "created", "modified", "name", "description", "indicator_types", "pattern", "pattern_type", "valid_from", "confidence", "labels",
    "x_flow_identifier", "x_threat_class", "x_subtype", "x_severity", "x_confidence_calibrated", "x_detector", "x_latency_ms", "x_model_lineage", "x_supporting_evidence",
    "x_detection_context", "x_prev_hash", "external_references",
)


def alert_id(cls: Column, subtype: Column, ts_ns: Column, flow_id: Column, source: Column) -> Column:
    seed = F.concat_ws("|", cls, F.coalesce(subtype, F.lit("")), ts_ns.cast("string"), flow_id, F.coalesce(source, F.lit("")))
    return F.concat(F.lit("indicator--"), scalar.uuid5(ID_NAMESPACE, seed))


def technique(cls: Column) -> Column:
    """MITRE references of a class: an array of one struct, empty for classes without."""
    known = F.create_map(*[x for k, (i, d) in scalar.TECHNIQUES.items() for x in (F.lit(k), F.struct(F.lit("mitre-attack").alias("source_name"), F.lit(i).alias("external_id"), F.lit(d).alias("description")))])
    one = F.element_at(known, cls)
    return F.when(one.isNull(), F.array().cast("array<struct<source_name: string, external_id: string, description: string>>")).otherwise(F.array(one))


def headline(cls: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in HEADLINES.items() for x in (k, v)])
    return F.coalesce(F.element_at(names, cls), F.lit("Suspicious traffic"))


def top_evidence(evidence: Column, n: int = MOST_EVIDENCE) -> Column:
    """The n rows (feature, value, contribution) of largest absolute contribution, then by name."""
    keyed = F.array_sort(F.transform(evidence, lambda e: F.struct((-F.abs(e["contribution"])).alias("k"), e["feature"].alias("f"), e.alias("e"))))
    return F.slice(F.transform(keyed, lambda x: x["e"]), 1, n)


def build(detections: DataFrame) -> DataFrame:
    """Alert documents of detections (ts_ns, threat_class, subtype, confidence, severity, source, flow_id, proto, src_ip,
    dst_ip, dst_port, evidence; where known also src_port, directionality, completeness_flag, window_start, window_end,
    latency_ns, calibrated, model_id, model_hash, dataset_version, sampling_active, sampling_ratio, shedding_tier).  Times
    are cut to milliseconds.  ``x_prev_hash`` is that of an empty chain until the ledger takes the alert."""
    c = F.col
    score = scalar.confidence_score(c("confidence"))
    created = scalar.iso_ms(F.timestamp_micros(scalar.whole(c("ts_ns"), 1000)))
    known = lambda name, otherwise: F.coalesce(c(name), F.lit(otherwise)) if name in detections.columns else F.lit(otherwise)
    at = lambda name: F.coalesce(c(name), created) if name in detections.columns else created
    evidence = top_evidence(c("evidence"))
    flow = F.struct(
        c("flow_id").alias("flow_id"),
        c("proto").alias("proto"),
        c("src_ip").alias("src_ip"),
        c("dst_ip").alias("dst_ip"),
        known("src_port", 0).alias("src_port"),
        c("dst_port").alias("dst_port"),
        known("directionality", "UNKNOWN").alias("directionality"),
        known("completeness_flag", False).alias("completeness_flag"),
        at("window_start").alias("window_start"),
        at("window_end").alias("window_end"),
    )
    return detections.select(
        F.lit("indicator").alias("type"),
        F.lit("2.1").alias("spec_version"),
        alert_id(c("threat_class"), c("subtype"), c("ts_ns"), c("flow_id"), c("source")).alias("id"),
        created.alias("created"),
        created.alias("modified"),
        headline(c("threat_class")).alias("name"),
        explain.summary(F.slice(evidence, 1, 3), headline(c("threat_class"))).alias("description"),
        F.array(F.lit("anomalous-activity")).alias("indicator_types"),
        scalar.stix_pattern(c("proto"), c("dst_ip"), c("dst_port")).alias("pattern"),
        F.lit("stix").alias("pattern_type"),
        created.alias("valid_from"),
        score.alias("confidence"),
        F.array(F.lit("cii-relevant")).alias("labels"),
        flow.alias("x_flow_identifier"),
        c("threat_class").alias("x_threat_class"),
        F.coalesce("subtype", F.lit("")).alias("x_subtype"),
        scalar.alert_severity(c("severity"), score).alias("x_severity"),
        known("calibrated", False).alias("x_confidence_calibrated"),
        F.coalesce("source", F.lit("unknown")).alias("x_detector"),
        F.round(known("latency_ns", 0) / 1e6, 3).alias("x_latency_ms"),
        F.struct(*[known(x, "none").alias(x) for x in LINEAGE]).alias("x_model_lineage"),
        evidence.alias("x_supporting_evidence"),
        F.struct(known("sampling_active", False).alias("sampling_active"), known("sampling_ratio", 1.0).alias("sampling_ratio"), known("shedding_tier", "none").alias("shedding_tier")).alias("x_detection_context"),
        F.lit(GENESIS).alias("x_prev_hash"),
        technique(c("threat_class")).alias("external_references"),
    )


def problems(alerts: DataFrame) -> DataFrame:
    """alerts with ``problem``: the first contract that a row breaks, else null."""
    c = F.col
    flow, evidence = "x_flow_identifier", c("x_supporting_evidence")
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    sound = F.forall(evidence, lambda e: F.coalesce((F.length(e["feature"]) > 0) & number(e["value"]) & number(e["contribution"]), F.lit(False)))
    expected = F.create_map(*[F.lit(x) for k, (i, _) in scalar.TECHNIQUES.items() for x in (k, i)])
    mitre = F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"]
    checks = {
        "missing": reduce(Column.__or__, [c(x).isNull() for x in alerts.columns if x in REQUIRED]),
        "type": (c("type") != "indicator") | (c("spec_version") != "2.1"),
        "id": ~c("id").startswith("indicator--"),
        "confidence": ~c("confidence").between(0, 100),
        "class": ~c("x_threat_class").isin(*CLASSES),
        "severity": ~c("x_severity").isin(*SEVERITIES),
        "latency": ~(number(c("x_latency_ms")) & (c("x_latency_ms") >= 0)),
        "flow": reduce(Column.__or__, [c(f"{flow}.{x}").isNull() for x in FLOW_FIELDS]),
        "direction": ~c(f"{flow}.directionality").isin(*DIRECTIONS),
        "lineage": reduce(Column.__or__, [F.length(c(f"x_model_lineage.{x}")) == 0 for x in LINEAGE]),
        "context": c("x_detection_context.sampling_active").isNull() | c("x_detection_context.sampling_ratio").isNull() | c("x_detection_context.shedding_tier").isNull(),
        "evidence": (F.size(evidence) < 1) | (F.size(evidence) > MOST_EVIDENCE) | ~sound,
        "chain": ~c("x_prev_hash").rlike("^sha256:[0-9a-f]{64}$"),
        "technique": F.element_at(expected, c("x_threat_class")).isNotNull() & ~mitre.eqNullSafe(F.element_at(expected, c("x_threat_class"))),
    }
    out = F.lit(None).cast("string")
    for name, bad in reversed(checks.items()):
        out = F.when(F.coalesce(bad, F.lit(True)), name).otherwise(out)
    return alerts.withColumn("problem", out)


def verify_chain(ledger: DataFrame, order: str = "pos") -> DataFrame:
    """(records, broken_at, reason) of a ledger (pos, record, prev_hash, hash).  A line needs only the one before it, so
    lines are checked where they lie: neighbours meet by position, not in one sorted task."""
    before = ledger.select((F.col(order) + 1).alias(order), F.col("hash").alias("_before"))
    l = ledger.join(before, order, "left")
    expected = F.when(F.col(order) == 0, F.lit(GENESIS)).otherwise(F.col("_before"))
    reason = F.when(~F.col("prev_hash").eqNullSafe(expected), "link").when(F.col("hash") != scalar.chain_hash(F.col("record"), F.col("prev_hash")), "hash")
    return l.withColumn("_r", reason).agg(F.count(F.lit(1)).alias("records"), F.min(F.when(F.col("_r").isNotNull(), F.col(order))).alias("broken_at"), F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col(order))).alias("reason"))


def chained(records: list[str], previous: str = GENESIS) -> list[tuple[int, str, str, str]]:
    """Ledger lines (pos, record, prev_hash, hash) of canonical records, in order: a chain has one writer."""
    import hashlib

    out = []
    for pos, record in enumerate(records):
        digest = "sha256:" + hashlib.sha256((record + previous).encode()).hexdigest()
        out.append((pos, record, previous, digest))
        previous = digest
    return out


def integrity(rows: DataFrame) -> Column:
    """State of a stored alert by its ledger line: failed, untrusted, unanchored or verified."""
    c = F.col
    return F.when(c("ledger_hash").isNull() | ~c("chain_ok"), "failed").when(~c("trusted"), "untrusted").when(c("pos") >= c("anchored"), "unanchored").otherwise("verified")


def page(alerts: DataFrame, cursor: int, limit: int, seq: str = "seq") -> DataFrame:
    """The next ``limit`` rows past a cursor, each with whether more follow."""
    limit = max(1, min(1000, limit))
    rows = alerts.filter(F.col(seq) > cursor).orderBy(seq).limit(limit + 1)
    rn = F.row_number().over(Window.orderBy(seq))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return rows.withColumn("_rn", rn).withColumn("has_more", n > limit).filter(F.col("_rn") <= limit).drop("_rn")


def latest(alerts: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    return alerts.orderBy(F.col(seq).desc()).limit(max(1, min(1000, n)))


def dedupe(alerts: DataFrame) -> DataFrame:
    """One row an id: the first stored."""
    return alerts.groupBy("id").agg(F.min_by(F.struct(*[c for c in alerts.columns if c != "id"]), "seq").alias("_r")).select("id", "_r.*")


def ledger_head(ledger: DataFrame, order: str = "pos") -> DataFrame:
    """(records, head): the number of lines and the last hash."""
    return ledger.agg(F.count(F.lit(1)).alias("records"), F.max_by("hash", order).alias("head"))


def anchors(ledger: DataFrame, every: int = 100, order: str = "pos") -> DataFrame:
    """(count, chain_head) after every ``every`` lines; unsigned."""
    return ledger.filter((F.col(order) + 1) % every == 0).select((F.col(order) + 1).alias("count"), F.col("hash").alias("chain_head"))


def check_anchors(anchors_: DataFrame, ledger: DataFrame, order: str = "pos") -> DataFrame:
    """Anchors that the ledger does not bear out: (count, state)."""
    at = ledger.select((F.col(order) + 1).alias("count"), F.col("hash").alias("_h"))
    state = F.when(F.col("_h").isNull(), "beyond the ledger").when(F.col("_h") != F.col("chain_head"), "differs")
    return anchors_.join(at, "count", "left").withColumn("state", state).filter("state IS NOT NULL").select("count", "state")
