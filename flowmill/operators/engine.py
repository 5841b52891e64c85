"""The whole run: packets to flows, features, rules, detections with evidence, alerts and their chain.

Each detector's rows become detections of one shape (``emitted``).  A row that a list or missing evidence keeps from being an
alert stays in the table with its ``reason``, so that what was suppressed can be counted.  Everything is one plan over the
packets; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import scalar
from flowmill.operators import alerts, detectors, features, flows

SECOND, MINUTE = 1_000_000, 60_000_000
#: What stands for a source that may be forged.
SPOOFED = "spoofed - low attribution confidence"

# What follows is written as SQL text: a rule's margins, evidence and flow are dozens of small expressions, and as text they
# reach the planner in one step.


def past(value: str, threshold: float, span: float) -> str:
    """How far ``value`` is past a threshold, 0 to 1 over ``span``."""
    return f"greatest(0D, least(1D, ({value} - {threshold}) / {float(span)}D))"


def ip(n: str) -> str:
    return f"concat_ws('.', {', '.join(f'cast(shiftright(cast({n} AS BIGINT), {k}) & 255 AS STRING)' for k in (24, 16, 8, 0))})"


def iso(us: str) -> str:
    return f"date_format(timestamp_micros(cast({us} AS BIGINT)), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"


def proto_name(proto: str) -> str:
    return f"CASE {proto} WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' ELSE concat('IP-', {proto}) END"


def flow_identifier(proto: str, src: str, dst: str, dst_port: str, start_us: str, end_us: str, direction: str = "'FWD_ONLY'", src_port: str = "0") -> str:
    """The flow that an alert names; src and dst are text, times microseconds."""
    return f"""named_struct('flow_id', format_string('%s %s:%d>%s:%d', {proto}, if({src} = '{SPOOFED}', 'spoofed', {src}), cast({src_port} AS INT), {dst}, cast({dst_port} AS INT)), 'proto', {proto}, 'src_ip', {src}, 'dst_ip', {dst},
 'src_port', cast({src_port} AS INT), 'dst_port', cast({dst_port} AS INT), 'directionality', {direction}, 'completeness_flag', {direction} = 'BIDIRECTIONAL', 'window_start', {iso(start_us)}, 'window_end', {iso(end_us)})"""


def emitted(rows: DataFrame, detector: str, threat: str, ts_us: str, flow: str, margins: list[str], evidence: list[tuple[str, str, str]], reason: str = "cast(NULL AS STRING)") -> DataFrame:
    """Detections of ``rows`` (subtype): confidence from the margins by which the rule's clauses are passed (m0, m1, ... in
    what follows), evidence as (feature, value, contribution), values that are none or not finite left out."""
    n = len(margins)
    sure = f"round(0.5D + 0.5D * ({' + '.join(f'm{k}' for k in range(n))}) / {n}, 4)"
    items = ", ".join(f"named_struct('feature', '{f}', 'value', cast({v} AS DOUBLE), 'contribution', cast({c} AS DOUBLE))" for f, v, c in evidence)
    measured = rows.selectExpr("*", *[f"coalesce({x}, 0D) AS m{k}" for k, x in enumerate(margins)])
    scored = measured.selectExpr("*", f"{sure} AS _sure")
    low, mid, high = (f"_sure < {limit} THEN '{name}'" for limit, name in scalar.SEVERITY_BANDS)
    return scored.selectExpr(
        f"cast({ts_us} AS BIGINT) * 1000 AS ts_ns",
        f"'{detector}' AS detector",
        f"'{threat}' AS threat_class",
        "subtype",
        "_sure AS confidence",
        f"CASE WHEN {low} WHEN {mid} WHEN {high} ELSE 'CRITICAL' END AS severity",
        "'rule' AS source",
        f"{flow} AS flow",
        f"array({', '.join(f'round(m{k}, 4)' for k in range(n))}) AS rule_margins",
        f"filter(array({items}), e -> e.value IS NOT NULL AND NOT isnan(e.value) AND abs(e.value) < double('infinity')) AS evidence",
        f"{reason} AS reason",
    )


def _of(**by: str) -> str:
    """SQL of the value for the row's subtype, told by its beginning; the last stands for all others."""
    *some, (_, last) = by.items()
    return "CASE " + " ".join(f"WHEN subtype LIKE '{k.replace('_', '-')}%' THEN {v}" for k, v in some) + f" ELSE {last} END"


def ddos(packets: DataFrame) -> DataFrame:
    f = detectors.with_prior(detectors.admitted(detectors.ddos_features(packets)), ["host"], "bucket", "pps", 60, rates=detectors.rates(packets))
    d = detectors.ddos_rule(f)
    pick = lambda syn, flood, reflection, held: _of(syn=syn, udp_flood=flood, udp_reflection=reflection, held=held)
    rate, asked, amplified = past("deviation", 4, 4), past("syn_synack_ratio", 4, 16), past("amplification", 5, 20)
    spread, fixed = past("explosion", 0.5, 0.5), past("collapse", 0.5, 0.5)
    margins = [
        pick(rate, rate, rate, past("half_open", 120, 240)),
        pick(spread, spread, fixed, past("0.1 - teardown", 0, 0.1)),
        pick(asked, amplified, amplified, past("200 - mean_bytes", 0, 120)),
    ]
    no = "NULL"
    evidence = [
        ("pps_to_dst_ewma_dev", pick(*["deviation"] * 3, no), "m0"),
        ("entropy_explosion_score", pick("explosion", "explosion", no, no), "m1"),
        ("entropy_collapse_score", pick(no, no, "collapse", no), "m1"),
        ("syn_synack_ratio_1s", pick("syn_synack_ratio", no, no, no), "m2"),
        ("amplification_ratio", pick(no, "amplification", "amplification", no), "m2"),
        ("src_cardinality_growth", pick(*["growth"] * 3, no), "0"),
        ("half_open_60s", pick(no, no, no, "half_open"), "m0"),
        ("teardown_ratio_60s", pick(no, no, no, "teardown"), "m1"),
        ("mean_pkt_bytes_1s", pick(no, no, "mean_bytes", "mean_bytes"), pick("0", "0", "0", "m2")),
    ]
    end = f"(bucket + 1) * {SECOND}"
    src = pick(f"'{SPOOFED}'", f"'{SPOOFED}'", "concat('<', sources60, ' reflectors>')", "concat('<', sources60, ' concurrent sources>')")
    flow = flow_identifier(_of(udp="'UDP'", tcp="'TCP'"), src, ip("host"), "0", f"{end} - {pick(*[str(SECOND)] * 3, str(MINUTE))}", end, _of(udp_reflection="'REV_ONLY'", other="'FWD_ONLY'"))
    return emitted(d, "ddos", "volumetric-ddos", end, flow, margins, evidence)


def protocol_flood(packets: DataFrame, absolute: float, floor: float, syn_absolute: float = 0, syn_floor: float = 0) -> DataFrame:
    """Off unless asked for: rates alone name no attack."""
    d = detectors.flood_rule(packets, SECOND, absolute, floor, syn_absolute=syn_absolute, syn_floor=syn_floor)
    either = lambda syn, other: _of(tcp_syn=syn, other=other)
    rate, dev = either("syns", "n"), either("syn_deviation", "deviation")
    base = f"if(why = 'absolute', {either(f'{syn_absolute}D', f'{float(absolute)}D')}, {either(f'{syn_floor}D', f'{float(floor)}D')})"
    over = f"greatest(0D, least(1D, ({rate} - {base}) / greatest({base}, 1D)))"
    evidence = [("pps_to_dst", either("NULL", "n"), "m0"), ("syn_attempts_per_second", either("syns", "NULL"), "m0"), ("pps_to_dst_ewma_dev", either("NULL", "deviation"), "m1"), ("syn_attempts_ewma_dev", either("syn_deviation", "NULL"), "m1"), ("mean_pkt_bytes_1s", "bytes / n", "0")]
    end = f"(bucket + 1) * {SECOND}"
    flow = flow_identifier(proto_name("proto"), "'multiple-or-unattributed'", ip("dst_ip"), "0", f"{end} - {SECOND}", end)
    return emitted(d, "protocol_flood", "volumetric-ddos", end, flow, [over, f"if(why = 'absolute', {over}, {past(dev, 6, 6)})"], evidence)


def scan(oriented: DataFrame) -> DataFrame:
    d = detectors.scan_rule(detectors.scan_features(oriented))
    pick = lambda vertical, strobe, sweep: _of(vertical=vertical, strobe=strobe, sweep=sweep)
    size = past("120 - bytes_per_probe", 0, 80)
    margins = [pick(past("vertical", 30, 300), past("hosts", 30, 200), past("horizontal", 30, 200)), pick(size, past("20 - ports", 0, 10), size), past("0.3 - completion", 0, 0.3)]
    no = "NULL"
    evidence = [
        ("vertical_fanout_60s", pick("vertical_60", no, "vertical_60"), pick("m0", "0", "0")),
        ("vertical_fanout_1s", pick("vertical_1", no, no), "0"),
        ("vertical_fanout_3600s", pick("vertical_3600", no, no), "0"),
        ("horizontal_fanout_60s", pick("horizontal_60", no, "horizontal_60"), pick("0", "0", "m0")),
        ("horizontal_fanout_3600s", pick(no, no, "horizontal_3600"), "0"),
        ("source_distinct_hosts_3600s", pick(no, "hosts", no), "m0"),
        ("source_distinct_ports_3600s", pick(no, "ports", no), "m1"),
        ("strobe_score", pick(no, "strobe", no), "0"),
        ("mean_bytes_per_probe", "bytes_per_probe", pick("m1", "0", "m1")),
        ("probe_completion_ratio", "completion", "m2"),
    ]
    end = f"(bucket + 1) * {MINUTE}"
    dst = pick("'<one host>'", "concat('<', hosts, ' hosts>')", "concat('<', horizontal, ' hosts swept>')")
    flow = flow_identifier("'TCP'", ip("src_ip"), dst, "0", f"{end} - {pick(str(MINUTE), str(60 * MINUTE), str(MINUTE))}", end)
    return emitted(d, "scan", "recon-scanning", end, flow, margins, evidence)


def exfil(oriented: DataFrame, allowlist: DataFrame | None = None) -> DataFrame:
    """A peer that never answered is an alert, and is counted besides."""
    d = detectors.exfil_rule(detectors.exfil_windows(oriented), allowlist=allowlist)
    twice = d.selectExpr("*", "explode(if(reason IS NULL AND in_total = 0, array(NULL, 'reverse-direction-never-observed'), array(reason))) AS why")
    evidence = [("out_in_ratio_ewma", "ratio_ewma", "m0"), ("sustained_asymmetry_s", "sustained_s", "m1"), ("dst_novelty_score", "novelty", "m2"), ("peak_window_out_bytes", "peak", "0"), ("upload_burst_score", "peak / greatest(out_total, 1)", "0")]
    end = f"(bucket + 1) * {MINUTE}"
    flow = flow_identifier(proto_name("proto"), ip("client"), ip("server"), "port", f"{end} - (age_s + 60) * {SECOND}", end, "if(in_total > 0, 'BIDIRECTIONAL', 'FWD_ONLY')")
    return emitted(twice, "exfil", "data-exfiltration", end, flow, [past("ratio_ewma", 3, 20), past("sustained_s", 300, 900), past("novelty", 0, 1)], evidence, "why")


def named_queries(packets: DataFrame, bigrams: DataFrame, suffixes: list[str]) -> DataFrame:
    """DNS packets (qname, qtype, dns_response, dns_rcode, dns_answers) as the asker's queries with domain and score."""
    from flowmill.operators import stats

    asker = F.when(F.col("dns_response"), F.col("dst_ip")).otherwise(F.col("src_ip"))
    name = F.coalesce("qname", F.lit(""))
    q = packets.filter("dns_response IS NOT NULL AND (dns_response OR qname <> '')").select(
        asker.alias("src_ip"), "ts_us", F.col("dns_response").alias("is_response"), F.col("dns_rcode").alias("rcode"), F.col("dns_answers").alias("answers"), "qtype", name.alias("qname"), scalar.registrable(name, suffixes).alias("domain"), scalar.stem(name, suffixes).alias("stem")
    )
    ll = stats.bigram_score(q.filter("NOT is_response").select("stem"), "stem", bigrams)
    return q.join(ll, "stem", "left").withColumn("score", scalar.name_score(scalar.char_entropy(F.col("stem")), F.coalesce("bigram_ll", F.lit(0.0))))


def dns(queries: DataFrame, wildcards: DataFrame | None = None) -> DataFrame:
    """Tunnels and campaigns; of a source and window the tunnel comes first, and one cooldown holds for both."""
    width = 300 * SECOND
    t = detectors.tunnel_rule(detectors.dns_zones(queries, width), wildcards=wildcards).withColumn("kind", F.lit(0))
    g = detectors.dga_rule(detectors.dns_sources(queries, width)).withColumns({"kind": F.lit(1), "reason": F.lit(None).cast("string")})
    both = t.unionByName(g, allowMissingColumns=True)
    # a suppressed row starts no cooldown: it is a subject of its own
    spaced = detectors.spaced_out(both.withColumn("_own", F.when(F.col("reason").isNotNull(), F.struct("bucket", "domain"))), ["src_ip", "_own"], "bucket", 1, "kind", "domain")
    pick = lambda tunnel, wild, words: _of(dns_tunnel=tunnel, dga_high=wild, words=words)
    many, missing, odd, even = past("domains", 20, 200), past("nx_ratio", 0.5, 0.4), past("mean_score", 0.55, 0.35), past("0.55 - mean_score", 0, 0.4)
    margins = [pick(past("names", 50, 450), odd, many), pick(f"if(windows >= 2, {past('excess', 4, 16)}, 0D)", many, missing), pick(past("txt_ratio", 0.3, 0.5), missing, even)]
    no = "NULL"
    evidence = [
        ("subdomain_cardinality", pick("names", no, no), "m0"),
        ("subdomain_excess", pick("excess", no, no), "m1"),
        ("qtype_txt_null_ratio", pick("txt_ratio", no, no), "m2"),
        ("dga_mean_name_score", pick(no, "mean_score", "mean_score"), pick("0", "m0", "m2")),
        ("distinct_regdom_300s", pick(no, "domains", "domains"), pick("0", "m1", "m0")),
        ("nx_response_ratio", pick(no, "nx_ratio", "nx_ratio"), pick("0", "m2", "m1")),
    ]
    end = f"(bucket + 1) * {width}"
    flow = flow_identifier("'UDP'", ip("src_ip"), "coalesce(domain, '<resolver>')", "53", f"{end} - {width}", end)
    return emitted(spaced, "dga", "dga-dns-tunnelling", end, flow, margins, evidence, "reason")


def encrypted(oriented: DataFrame, reference: DataFrame, tie: str = "event_id") -> DataFrame:
    """oriented: also tcp_print and ja4."""
    p = oriented.filter("proto = 6").withColumn("flow", F.struct(*flows.KEY, "session"))
    d = detectors.encrypted_rule(p, reference, ["ts_us", tie]).withColumn("subtype", F.coalesce("subtype", F.lit("")))
    pick = lambda differs, rare: _of(ja4_tcp_fingerprint=differs, rare=rare)
    margins = [pick(past("confidence", 0.5, 0.5), past("0.15 - pair_share", 0, 0.15)), pick(past("support", 3, 12), past("ja4_count", 20, 200)), pick(past("repeats", 2, 10), "0D")]
    no = "NULL"
    evidence = [
        ("fingerprint_consistency_score", "consistency", pick("m0", "0")),
        ("ja4_reference_support_hosts", pick("support", no), "m1"),
        ("host_fingerprint_repeats", pick("repeats", no), "m2"),
        ("ja4_tcp_pair_share", pick(no, "pair_share"), "m0"),
        ("ja4_observation_count", pick(no, "ja4_count"), "m1"),
    ]
    flow = flow_identifier("'TCP'", ip("client"), ip("server"), "server_port", "ts_us", "ts_us", src_port="client_port")
    return emitted(d, "encrypted", "encrypted-malware", "ts_us", flow, margins, evidence, "reason")


def beacons(oriented: DataFrame, tie: str = "event_id", busy_samples: int = 0) -> DataFrame:
    keys = ["proto", "client", "server", "server_port"]
    starts = detectors.latest_epoch(detectors.beacon_starts(oriented, tie), keys)
    d = features.beacon_rule(features.beacons(starts, keys, "ts_us", tie, ("client", "server", "server_port")), busy_samples=busy_samples)
    margins = [f"if(significant, {past('-log10(greatest(ls_fap, 1e-30D))', 3, 3)}, {past('0.35 - iat_cv', 0, 0.35)})", f"if(significant, {past('ls_peak_power', 8, 20)}, {past('beacon_sample_count', 20, 60)})", past("dst_stability", 0.5, 0.5)]
    evidence = [("ls_fap", "ls_fap", "if(significant, m0, 0)"), ("ls_peak_power", "ls_peak_power", "if(significant, m1, 0)"), ("dst_stability", "dst_stability", "m2"), ("ls_peak_period_s", "ls_peak_period_s", "0"), ("iat_cv", "iat_cv", "if(significant, 0, m0)"), ("beacon_sample_count", "beacon_sample_count", "if(significant, 0, m1)")]
    flow = flow_identifier(proto_name("proto"), ip("client"), ip("server"), "server_port", f"last_us - beacon_span_s * {SECOND}", "last_us")
    return emitted(d, "beaconing", "c2-beaconing", "last_us", flow, margins, evidence)


def detect(packets: DataFrame, bigrams: DataFrame, ja4_reference: DataFrame, suffixes: list[str], wildcards: DataFrame | None = None, allowlist: DataFrame | None = None, idle_us: int = 120 * SECOND, tie: str = "event_id", floods: dict | None = None) -> DataFrame:
    """Detections of all rules.  packets: event_id, ts_us, proto, src_ip, dst_ip, src_port, dst_port, length, tcp_flags,
    packets, qname, qtype, dns_response, dns_rcode, dns_answers, ja4, tcp_print.  floods: limits of ``protocol_flood``,
    which is off without them.  Four rules read the oriented packets, so these are persisted (memory, then disk)."""
    oriented = flows.oriented(packets, idle_us, tie).persist()
    found = [ddos(packets), scan(oriented), exfil(oriented, allowlist), dns(named_queries(packets, bigrams, suffixes), wildcards), encrypted(oriented, ja4_reference, tie), beacons(oriented, tie)]
    if floods:
        found.append(protocol_flood(packets, **floods))
    return reduce(DataFrame.unionByName, found)


def suppressed(detections: DataFrame) -> DataFrame:
    """(detector, reason, n): what was seen and kept from being an alert, or counted beside it."""
    return detections.filter("reason IS NOT NULL").groupBy("detector", "reason").agg(F.count(F.lit(1)).alias("n"))


def to_alerts(detections: DataFrame) -> DataFrame:
    """Alert documents of the detections that nothing suppressed."""
    d = detections.filter("reason IS NULL").select("*", "flow.*").drop("flow", "reason", "rule_margins")
    return alerts.build(d)


def chained(documents: DataFrame, day: str = "created") -> DataFrame:
    """Alerts in order of creation with ``seq`` and the ledger's record; alerts are few, packets many."""
    w = Window.partitionBy(F.substring(day, 1, 10)).orderBy(day, "id")
    return documents.withColumn("seq", F.row_number().over(w))


def verdict(detections: DataFrame, key: list[str]) -> DataFrame:
    """(key, label, confidence): the class of a row's surest detection; benign where there is none is the caller's."""
    best = F.max_by(F.struct("threat_class", "confidence"), F.struct("confidence", "threat_class"))
    return detections.filter("reason IS NULL").groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.threat_class").alias("label"), F.col("b.confidence").alias("confidence"))


def subject(threat: Column) -> Column:
    """Which end of a flow an alert of a class is about."""
    return F.when(threat == "volumetric-ddos", "dst").otherwise("src")
