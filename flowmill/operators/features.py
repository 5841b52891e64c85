"""Registry features of every group by their published names, over packets and name queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import scalar
from flowmill.operators import detectors, flows, windows

SECOND = 1_000_000


def flow_features(packets: DataFrame, idle_us: int = 120 * SECOND, tie: str = "event_id") -> DataFrame:
    f = flows.structural(flows.flow_table(packets, idle_us, tie))
    return f.withColumn("directionality", F.col("completeness_flag").cast("int"))


def ddos(packets: DataFrame, short_us: int = SECOND, long_us: int = 60 * SECOND) -> DataFrame:
    f = detectors.with_prior(detectors.admitted(detectors.ddos_features(packets, short_us, long_us)), ["host"], "bucket", "pps", long_us // short_us, rates=detectors.rates(packets, short_us))
    names = {
        "pps": "pps_to_dst",
        "deviation": "pps_to_dst_ewma_dev",
        "src_entropy": "src_entropy_1s",
        "src_entropy_ratio": "src_entropy_ratio_1s",
        "sources": "src_cardinality_1s",
        "sources60": "src_cardinality_60s",
        "growth": "src_cardinality_growth",
        "syn_synack_ratio": "syn_synack_ratio_1s",
        "udp_share": "udp_packet_share",
        "service_share": "reflection_service_share",
        "udp_egress": "udp_egress_observed",
        "amplification": "amplification_ratio",
        "mean_bytes": "mean_pkt_bytes_1s",
        "half_open": "half_open_60s",
        "teardown": "teardown_ratio_60s",
        "ports60": "concurrent_src_ports_60s",
    }
    f = f.withColumns({"entropy_explosion_score": detectors.explosion_score(), "entropy_collapse_score": detectors.collapse_score()})
    return f.withColumnsRenamed(names).drop("bytes_in60", "bytes_out60", "basis")


def scan(packets: DataFrame, scales_us: tuple[int, int, int] = (SECOND, 60 * SECOND, 3600 * SECOND)) -> DataFrame:
    """Per source and middle window."""
    names = {f"{k}_{w}": f"{k}_fanout_{w}s" for k in ("vertical", "horizontal") for w in (1, 60, 3600)}
    names |= {"ports": "source_distinct_ports_3600s", "hosts": "source_distinct_hosts_3600s", "probes": "scan_probe_count_60s", "rst_ratio": "rst_response_ratio", "completion": "probe_completion_ratio", "bytes_per_probe": "mean_bytes_per_probe", "strobe": "strobe_score"}
    return detectors.scan_features(packets, scales_us).withColumnsRenamed(names).drop("bytes", "syn_ack", "rst")


def exfil(oriented: DataFrame, width_us: int = 60 * SECOND, wide_us: int = 3600 * SECOND) -> DataFrame:
    w = detectors.exfil_windows(oriented, width_us, wide_us=wide_us)
    return w.select(
        "client",
        "server",
        "bucket",
        scalar.ratio(F.col("out_total"), F.col("in_total")).alias("out_in_byte_ratio"),
        F.col("ratio_ewma").alias("out_in_ratio_ewma"),
        F.col("sustained_s").alias("sustained_asymmetry_s"),
        F.col("out_total").alias("outbound_bytes_total"),
        F.col("in_total").alias("inbound_bytes_total"),
        F.col("peak").alias("peak_window_out_bytes"),
        scalar.ratio(F.col("peak"), F.col("out_total")).alias("upload_burst_score"),
        F.col("fanout").alias("dst_source_fanout_3600s"),
        F.col("novelty").alias("dst_novelty_score"),
        F.col("age_s").alias("peer_age_s"),
        (F.col("in_total") > 0).alias("reverse_direction_observed"),
    )


def dns(queries: DataFrame, width_us: int = 300 * SECOND) -> DataFrame:
    """Per source, zone and window: the source's and the zone's features."""
    source = detectors.dns_sources(queries, width_us).withColumnsRenamed({"mean_score": "dga_mean_name_score", "nx_ratio": "nx_response_ratio", "empty_ratio": "empty_answer_ratio", "domains": "distinct_regdom_300s", "queries": "source_query_count_300s"})
    zone = detectors.dns_zones(queries, width_us).withColumnsRenamed({"names": "subdomain_cardinality", "baseline": "subdomain_baseline", "windows": "subdomain_baseline_windows", "excess": "subdomain_excess", "txt_ratio": "qtype_txt_null_ratio", "txt_dev": "qtype_txt_null_dev"})
    return zone.drop("queries", "txt").join(source.drop("responses", "nx", "empty", "txt_null"), ["src_ip", "bucket"])


def tls(hellos: DataFrame) -> DataFrame:
    """Hellos (tls_version, tls_extensions, tls_alpn, ...) with the features of the hello itself."""
    listed = F.filter("tls_extensions", lambda x: ~scalar.reserved(x))
    return hellos.withColumns({"tls_ext_count": F.size(listed), "tls_alpn_is_h2": (F.coalesce("tls_alpn", F.lit("")) == "h2").cast("int")})


def beacons(starts: DataFrame, keys: list[str], ts: str, tie: str, by: tuple[str, ...]) -> DataFrame:
    """Statistics and strongest period of each channel; by: the source, and what tells its destinations apart."""
    return detectors.channel_features(starts, keys, ts, tie, by)


def names(queries: DataFrame, model: DataFrame, suffixes: list[str]) -> DataFrame:
    """queries (qname, ...) with the lexical features of the name; the bigram model is one row a bigram."""
    from flowmill.operators import stats

    q = queries.withColumn("_stem", scalar.stem(F.col("qname"), suffixes))
    ll = stats.bigram_score(q.select("_stem"), "_stem", model).withColumnRenamed("bigram_ll", "qname_bigram_ll")
    q = q.join(ll, "_stem", "left").withColumns({"qname_char_entropy": scalar.char_entropy(F.col("_stem")), "digit_ratio": scalar.digit_ratio(F.col("_stem")), "consonant_run_max": scalar.consonant_run(F.col("_stem")), **scalar.name_shape(F.col("qname"))})
    return q.withColumns({"dga_entropy_component": scalar.entropy_component(F.col("qname_char_entropy")), "dga_bigram_component": scalar.bigram_component(F.col("qname_bigram_ll"))}).withColumn("dga_name_score", 0.4 * F.col("dga_entropy_component") + 0.6 * F.col("dga_bigram_component")).drop("_stem")


def beacon_rule(features: DataFrame, fap: float = 1e-3, power: float = 8.0, stability: float = 0.5, cv: float = 0.75, busy_samples: int = 0) -> DataFrame:
    """Channels with a significant period, or regular ones of enough samples, towards a stable destination.  A source of many
    destinations passes only with ``busy_samples`` even gaps and more (0: never)."""
    c = F.col
    significant = (c("ls_fap") < fap) & (c("ls_peak_power") >= power)
    regular = (c("beacon_sample_count") >= 20) & (c("iat_cv") <= 0.35) & (F.abs(c("ls_peak_period_s") - c("iat_mean")) < 0.15 * c("iat_mean"))
    busy = regular & F.lit(busy_samples > 0) & (c("beacon_sample_count") >= busy_samples) & (c("beacon_span_s") >= 600) & (c("iat_cv") <= 0.25)
    f = features.withColumns({"significant": significant, "regular": regular})
    out = (c("ls_peak_period_s") < 2) | (c("iat_cv") > cv) | ~(c("significant") | c("regular"))
    subtype = F.when(out, None).when(c("dst_stability") >= stability, "periodic-c2-checkin").when(busy, "busy-source-periodic-channel")
    return f.withColumn("subtype", subtype).filter("subtype IS NOT NULL")


def run_length(rows: DataFrame, host: str, fingerprint: str, order: list[str]) -> DataFrame:
    return windows.repeats(rows, [host], order, fingerprint).withColumnRenamed("run", "host_fingerprint_repeats")


def distinct_per(keys: list[str], value: str, order: str, back_us: int):
    """Distinct values of a key within the last ``back_us``, row by row."""
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(-back_us, 0)
    return F.size(F.collect_set(value).over(w))
