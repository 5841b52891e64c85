"""The feature registry: names by group, and checks against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The names that results carry.
GROUPS = {
    "flow-structural": "duration pkts_fwd pkts_rev bytes_fwd bytes_rev bytes_per_pkt_fwd bytes_per_pkt_rev flags_seen_bitmap completeness_flag directionality orientation_confidence",
    "context": "initiator_is_lo sampling_active sampling_ratio shedding_tier",
    "ddos": "pps_to_dst pps_to_dst_ewma_dev src_entropy_1s src_entropy_ratio_1s src_cardinality_1s src_cardinality_60s src_cardinality_growth entropy_explosion_score entropy_collapse_score syn_synack_ratio_1s udp_packet_share reflection_service_share udp_egress_observed amplification_ratio mean_pkt_bytes_1s half_open_60s teardown_ratio_60s concurrent_src_ports_60s",
    "beaconing": "iat_mean iat_std iat_cv iat_skew iat_kurtosis ls_peak_period_s ls_peak_power ls_fap dst_stability beacon_sample_count beacon_span_s",
    "dga-dns": "qname_char_entropy qname_bigram_ll qname_len label_count max_label_len digit_ratio consonant_run_max dga_entropy_component dga_bigram_component dga_name_score dga_mean_name_score nx_response_ratio empty_answer_ratio distinct_regdom_300s source_query_count_300s subdomain_cardinality subdomain_baseline subdomain_baseline_windows subdomain_excess qtype_txt_null_ratio qtype_txt_null_dev",
    "encrypted": "fingerprint_consistency_score ja4_tcp_pair_share ja4_observation_count tls_version tls_ext_count tls_alpn_is_h2 splt_len splt_mean_abs_len splt_len_cv splt_iat_mean splt_iat_cv splt_up_down_ratio splt_direction_changes ja4_reference_support_hosts host_fingerprint_repeats",
    "scan": "vertical_fanout_1s vertical_fanout_60s vertical_fanout_3600s horizontal_fanout_1s horizontal_fanout_60s horizontal_fanout_3600s source_distinct_ports_3600s source_distinct_hosts_3600s strobe_score rst_response_ratio probe_completion_ratio mean_bytes_per_probe scan_probe_count_60s",
    "exfil": "out_in_byte_ratio out_in_ratio_ewma sustained_asymmetry_s outbound_bytes_total inbound_bytes_total peak_window_out_bytes upload_burst_score dst_source_fanout_3600s dst_novelty_score peer_age_s reverse_direction_observed",
}
NOT_IN_MODELS = {"udp_packet_share", "reflection_service_share", "udp_egress_observed"}


def model_inputs() -> list[str]:
    """Names that a model reads, in order."""
    return [x for g, names in GROUPS.items() if g != "context" for x in names.split() if x not in NOT_IN_MODELS]


def registry(spark: SparkSession) -> DataFrame:
    """(name, grp, model_input) of every feature."""
    used = set(model_inputs())
    return spark.createDataFrame([(x, g, x in used) for g, names in GROUPS.items() for x in names.split()], "name string, grp string, model_input boolean")


def unregistered(names: DataFrame, column: str = "name") -> DataFrame:
    """Names that the registry lacks."""
    known = registry(names.sparkSession).select(F.col("name").alias("_n"))
    return names.join(F.broadcast(known), F.col(column) == F.col("_n"), "left_anti")


def dense(rows: DataFrame, values: str = "features") -> DataFrame:
    """rows with every model input as a nullable column from a map of features."""
    return rows.select("*", *[F.element_at(F.col(values), F.lit(x)).alias(x) for x in model_inputs()])
