"""Rule detectors over packets, as windowed aggregations, ordered folds and predicates.

Windows are on a grid (the streaming processors anchor them at a key's first second).  Every detector has a features
function, one row a key and window, and a rule over those rows; thresholds are parameters with the published defaults.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import folds, scalar
from flowmill.operators import windows

SECOND = 1_000_000
#: Ports of services that reflect.
REFLECTION_PORTS = (17, 19, 53, 123, 161, 389, 1900, 3283, 3389, 3702, 5353, 11211)


def _sum(cond: Column, value: Column | str = "packets") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(F.when(cond, value).otherwise(0))


def normalised_entropy(counted: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, sources, total, entropy / ln(sources)) of counts by source."""
    # -sum p ln p = ln N - sum(n ln n) / N: sums that combine before the shuffle
    out = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("sources"), F.sum(n).alias("total"), F.sum(F.col(n) * F.log(F.col(n).cast("double"))).alias("_s"))
    h = F.log(F.col("total").cast("double")) - F.col("_s") / F.col("total")
    return out.withColumn("entropy", F.when(F.col("sources") >= 2, h / F.log(F.col("sources").cast("double"))).otherwise(0.0)).drop("_s")


# --- floods


def _two(windowed: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Each value the larger of its window's and the window's just before (``bucket``)."""
    return windowed.withColumns({v: windows.two_generations(windowed, keys, v) for v in values})


def ddos_features(packets: DataFrame, short_us: int = SECOND, long_us: int = 60 * SECOND) -> DataFrame:
    """Per destination and short window: rates, ratios, source entropy; and the long window's totals that it lies in, its
    distinct counts those of two generations.

    Each packet counts once for its destination and once, for replies, for its source: no self-join."""
    proto, flags = F.col("proto"), F.col("tcp_flags")
    tcp, udp = proto == 6, proto == 17
    syn, syn_ack = tcp & scalar.has_flags(flags, 2, 16), tcp & scalar.has_flags(flags, 18)
    side = F.explode(F.array(F.struct(F.col("dst_ip").alias("host"), F.lit(True).alias("inward")), F.struct(F.col("src_ip").alias("host"), F.lit(False).alias("inward")))).alias("e")
    p = packets.select("ts_us", "proto", "tcp_flags", "src_ip", "src_port", "dst_port", "length", "packets", side).select("*", "e.host", "e.inward").drop("e")
    inward = F.col("inward")
    by_src = (
        p.groupBy("host", windows.bucket(F.col("ts_us"), short_us).alias("bucket"), F.when(inward, F.col("src_ip")).alias("src"))
        .agg(
            _sum(inward).alias("n"),
            _sum(inward, "length").alias("bytes"),
            _sum(inward & syn).alias("syn"),
            _sum(inward & udp).alias("udp"),
            _sum(inward & udp & F.col("src_port").isin(*REFLECTION_PORTS)).alias("service"),
            _sum(~inward & syn_ack).alias("syn_ack"),
        )
        .withColumn("ln", F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n").cast("double"))).otherwise(0.0))
    )
    short = by_src.groupBy("host", "bucket").agg(*[F.sum(c).alias(c) for c in ("n", "bytes", "syn", "udp", "service", "syn_ack", "ln")], F.count("src").alias("sources")).filter("n > 0")
    long = p.groupBy("host", windows.bucket(F.col("ts_us"), long_us).alias("bucket")).agg(
        _sum(inward & syn).alias("syn60"),
        _sum(inward & tcp & scalar.has_flags(flags, 1)).alias("fin60"),
        _sum(inward & tcp & scalar.has_flags(flags, 4)).alias("rst60"),
        _sum(inward, "length").alias("bytes_in60"),
        _sum(~inward, "length").alias("bytes_out60"),
        _sum(inward & udp, "length").alias("udp_in"),
        _sum(~inward & udp, "length").alias("udp_out"),
        F.count_distinct(F.when(inward, F.col("src_ip"))).alias("sources60"),
        F.count_distinct(F.when(inward, F.struct("src_ip", "src_port"))).alias("ports60"),
    )
    long = _two(long, ["host"], "sources60", "ports60").withColumnRenamed("bucket", "long")
    joined = short.withColumn("long", scalar.whole(F.col("bucket") * short_us, long_us)).join(long, ["host", "long"])
    n, k = F.col("n").cast("double"), F.col("sources")
    entropy = F.when(k >= 2, (F.log(n) - F.col("ln") / n) / F.log(k.cast("double"))).otherwise(0.0)
    spread = F.least(n, F.lit(512.0))
    return joined.select(
        "host",
        "bucket",
        (F.col("n") * SECOND / short_us).alias("pps"),
        (F.col("bytes") / F.col("n")).alias("mean_bytes"),
        "sources",
        "sources60",
        "ports60",
        entropy.alias("src_entropy"),
        F.when((k >= 2) & (spread > 1), entropy * F.log2(k.cast("double")) / F.log2(spread)).otherwise(0.0).alias("src_entropy_ratio"),
        (F.col("sources60") / F.greatest(F.lit(1), k)).alias("growth"),
        scalar.ratio(F.col("syn"), F.col("syn_ack")).alias("syn_synack_ratio"),
        scalar.ratio(F.col("udp"), F.col("n")).alias("udp_share"),
        scalar.ratio(F.col("service"), F.col("udp")).alias("service_share"),
        scalar.ratio(F.col("udp_in"), F.col("udp_out")).alias("amplification"),
        (F.col("udp_out") > 0).alias("udp_egress"),
        F.greatest(F.lit(0), F.col("syn60") - F.col("fin60") - F.col("rst60")).alias("half_open"),
        scalar.ratio(F.col("fin60") + F.col("rst60"), F.col("syn60")).alias("teardown"),
        "bytes_in60",
        "bytes_out60",
    )


def admitted(features: DataFrame, least: float = 8.0) -> DataFrame:
    """features without distinct counts, and the scores made of them, until a destination's first window of ``least``
    packets a second has closed: quiet destinations keep no table of sources."""
    before = Window.partitionBy("host").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    hot = F.coalesce(F.max("pps").over(before) >= least, F.lit(False))
    masked = ("sources", "sources60", "ports60", "src_entropy", "src_entropy_ratio", "growth")
    kinds = dict(features.dtypes)
    f = features.withColumn("_hot", hot)
    return f.withColumns({c: F.when(F.col("_hot"), F.col(c)).otherwise(F.lit(0).cast(kinds[c])) for c in masked}).drop("_hot")


def explosion_score(f: str = "src_entropy_ratio", growth: str = "growth") -> Column:
    return scalar.clamp01((F.col(f) - 0.55) / 0.35) * scalar.clamp01((F.col(growth) - 2.0) / 6.0)


def collapse_score() -> Column:
    return F.when(F.col("sources") < 3, 0.0).otherwise(scalar.clamp01((3.0 - F.col("growth")) / 2.0) * scalar.clamp01((F.col("mean_bytes") - 120.0) / 280.0))


def folded(rows: DataFrame, key: list[str], order: str | Column, **folds_: Column) -> DataFrame:
    """rows with a column for each fold, an expression over ``_w``, the key's rows in order, that gives one value a row.  A
    key's windows meet in one array: one element a window that held packets, so it grows with time and not with traffic."""
    others = [c for c in rows.columns if c not in key]
    g = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((F.col(order) if isinstance(order, str) else order).alias("_t"), *[F.col(c) for c in others]))).alias("_w"))
    names = list(folds_)
    zipped = F.arrays_zip("_w", *[folds_[n].alias(n) for n in names])
    return g.select(*key, F.inline(zipped)).select(*key, *[F.col(f"_w.{c}").alias(c) for c in others], *names)


def with_baseline(rows: DataFrame, key: list[str], order: str, value: str, alpha: float = 0.1, sigmas: float = 4.0) -> DataFrame:
    """rows with ``deviation`` of ``value`` from the key's own clipped baseline."""
    return folded(rows, key, order, deviation=folds.clipped_baseline(F.transform("_w", lambda x: x[value]), alpha, sigmas))


def rates(packets: DataFrame, width_us: int = SECOND) -> DataFrame:
    """(bucket, pps) of every destination and window."""
    w = windows.tumbling(packets, ["dst_ip"], "ts_us", width_us, F.sum("packets").alias("n"))
    return w.select("bucket", (F.col("n") * SECOND / width_us).alias("pps"))


def population(rows: DataFrame, order: str, value: str, width: int, back: int = 60, half: float = 10.0, cap: float = 25.0) -> DataFrame:
    """(span, mean, var) of ``value`` over all keys in the ``back`` spans of ``width`` windows before, halved in weight every
    ``half`` spans; the first spans take their own.  Values beyond ``cap``, the rate that alarms ask for, count as it.

    Spans are summed where they lie and go to the spans they count in: no global order and no single task."""
    v = F.least(F.col(value).cast("double"), F.lit(float(cap)))
    own = rows.groupBy(scalar.whole(F.col(order), width).alias("span")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    later = own.select("span", "n", "s", "q", F.explode(F.sequence(F.lit(1), F.lit(back))).alias("j")).withColumn("w", F.pow(F.lit(0.5), F.col("j") / half))
    prior = later.groupBy((F.col("span") + F.col("j")).alias("span")).agg(*[F.sum(F.col(c) * F.col("w")).alias(f"p{c}") for c in "nsq"])
    both = own.join(prior, "span", "left")
    n, s, q = (F.coalesce(f"p{c}", c) for c in "nsq")
    return both.select("span", (s / n).alias("pop_mean"), F.greatest(F.lit(0.0), q / n - (s / n) * (s / n)).alias("pop_var"))


def with_prior(rows: DataFrame, key: list[str], order: str, value: str, width: int, alpha: float = 0.1, sigmas: float = 4.0, warmup: int = 5, cap: float = 25.0, rates: DataFrame | None = None) -> DataFrame:
    """rows with ``deviation`` from the key's own baseline after ``warmup`` windows, before that from the population's, and
    ``basis``, which of the two.  rates: (order, value) of all keys where they are cheaper to get than rows."""
    prior = population(rows if rates is None else rates, order, value, width, cap=cap)
    p = rows.withColumn("span", scalar.whole(F.col(order), width)).join(prior, "span").drop("span")
    xs = F.transform("_w", lambda x: F.struct(x[value].alias("x"), x["pop_mean"].alias("mean"), x["pop_var"].alias("var")))
    place = F.transform("_w", lambda _, i: F.when(i >= warmup, "destination").otherwise("population"))
    return folded(p, key, order, deviation=folds.primed_baseline(xs, alpha, sigmas, warmup), basis=place).drop("pop_mean", "pop_var")


def cooled(detections: DataFrame, key: list[str], ts: str, gap: int) -> DataFrame:
    """Times (key, ts) of detections at least ``gap`` after the last that was emitted."""
    g = detections.groupBy(*key).agg(F.array_sort(F.collect_set(F.col(ts).cast("long"))).alias("_t"))
    return g.select(*key, F.explode(folds.cooldown(F.col("_t"), gap)).alias(ts))


def spaced_out(detections: DataFrame, key: list[str], ts: str, gap: int, *ties: str) -> DataFrame:
    """detections that a cooldown of ``gap`` lets through, one of each time (the first by ``ties``)."""
    order = F.struct(ts, *[t for t in ties if t != ts])
    return folded(detections, key, order, _go=folds.passes(F.transform("_w", lambda x: x[ts]), gap)).filter("_go").drop("_go")


def ddos_rule(
    features: DataFrame, sigma: float = 4.0, explosion: float = 0.5, collapse: float = 0.5, syn_ratio: float = 4.0, amplification: float = 5.0, floor: float = 25.0, half_open: float = 120.0, udp: float = 0.8, gap: int = 60
) -> DataFrame:
    """Windows of ``features`` (with deviation) that a rule names, the first that holds, ``gap`` windows apart."""
    f = features.withColumns({"explosion": explosion_score(), "collapse": collapse_score()})
    c = F.col
    burst = c("deviation") > sigma
    subtype = (
        F.when((c("pps") < floor) & (c("half_open") < half_open), None)
        .when(burst & (c("explosion") >= explosion) & (c("syn_synack_ratio") > syn_ratio), "syn-flood-spoofed-source")
        .when(burst & (c("udp_share") >= udp) & (c("explosion") >= explosion) & (c("amplification") > amplification), "udp-flood-suspected-spoofed-source")
        .when(burst & (c("udp_share") >= udp) & (c("service_share") >= udp) & (c("collapse") >= collapse) & (c("amplification") > amplification), "udp-reflection-amplification")
        .when((c("half_open") >= half_open) & (c("teardown") <= 0.1) & (c("pps") <= 60) & (c("sources60") >= 4) & (c("mean_bytes") > 0) & (c("mean_bytes") <= 200), "connection-exhaustion")
    )
    return spaced_out(f.withColumn("subtype", subtype).filter("subtype IS NOT NULL"), ["host"], "bucket", gap)


def flood_rule(packets: DataFrame, width_us: int, absolute: float, floor: float, sigmas: float = 6.0, warmup: int = 10, syn_absolute: float = 0, syn_floor: float = 0, gap: int = 60) -> DataFrame:
    """Protocol floods by occupied windows of (proto, destination): an absolute limit, or a deviation after warm-up; of TCP
    the same for SYNs without ACK where all packets are no flood; ``gap`` windows apart.  Limits of 0 are off.  Flow
    records have no time for each packet and are left out."""
    live = packets.filter(~F.coalesce(F.col("from_flow_record"), F.lit(False))) if "from_flow_record" in packets.columns else packets
    syn = (F.col("proto") == 6) & scalar.has_flags(F.col("tcp_flags"), 2, 16)
    w = windows.tumbling(live.filter(F.col("proto").isin(1, 6, 17)), ["proto", "dst_ip"], "ts_us", width_us, F.sum("packets").alias("n"), _sum(syn).alias("syns"), F.sum("length").alias("bytes"))
    of = lambda name: folds.occupied_baseline(F.transform("_w", lambda x: x[name]), warmup)
    d = folded(w, ["proto", "dst_ip"], "bucket", deviation=of("n"), syn_deviation=of("syns"), seen=F.transform("_w", lambda _, i: i))

    def why(rate: Column, deviation: Column, limit: float, least: float) -> Column:
        over = F.when(rate >= limit, "absolute") if limit else F.lit(None).cast("string")
        unusual = F.when((F.col("seen") >= warmup) & (rate >= least) & (deviation >= sigmas), "baseline") if least else F.lit(None).cast("string")
        return F.coalesce(over, unusual)

    all_, syns = why(F.col("n"), F.col("deviation"), absolute, floor), F.when(F.col("proto") == 6, why(F.col("syns"), F.col("syn_deviation"), syn_absolute, syn_floor))
    name = F.when(all_.isNull(), "tcp-syn-rate-anomaly").when(F.col("proto") == 17, "udp-rate-anomaly").when(F.col("proto") == 1, "icmp-rate-anomaly").otherwise("tcp-rate-anomaly")
    d = d.withColumns({"why": F.coalesce(all_, syns), "subtype": name}).filter("why IS NOT NULL")
    return spaced_out(d, ["proto", "dst_ip"], "bucket", gap)


def burst_rule(packets: DataFrame, key: str, source: str, width_us: int, least: int = 60, entropy: float = 0.7, gap_us: int = 5 * SECOND) -> DataFrame:
    """Bursts against one key from many sources: count and normalised source entropy of a window, then a cooldown."""
    counted = packets.groupBy(key, windows.bucket(F.col("ts_us"), width_us).alias("bucket"), source).agg(F.sum("packets").alias("n"))
    f = normalised_entropy(counted, [key, "bucket"], "n").filter((F.col("total") >= least) & (F.col("entropy") >= entropy))
    f = f.withColumn("ts_us", (F.col("bucket") + 1) * width_us)
    fired = cooled(f, [key], "ts_us", gap_us)
    conf = F.round(F.least(F.lit(0.99), 0.55 + 0.04 * F.least(F.lit(10.0), F.col("total") / least) + 0.2 * F.col("entropy")), 4)
    return f.join(fired, [key, "ts_us"]).withColumn("confidence", conf).withColumn("severity", scalar.severity(F.col("confidence")))


def fallback_rules(packets: DataFrame, width_us: int = SECOND, wide_us: int = 60 * SECOND, least: int = 60, ratio: float = 5.0, entropy: float = 0.7, fanout: int = 60, gap_us: int = 5 * SECOND) -> DataFrame:
    """The two rules that need no other table: (subject, ts_us, threat_class, subtype, confidence, severity).  SYNs without
    ACK to one host in a window, for each SYN-ACK to it, while the packets of all hosts come from evenly many sources; and
    ports or hosts that one source's SYNs reach in a wide window."""
    at = windows.bucket(F.col("ts_us"), width_us).alias("bucket")
    even = normalised_entropy(packets.groupBy(at, "src_ip").agg(F.sum("packets").alias("n")), ["bucket"], "n").select("bucket", "entropy")
    tcp = packets.filter("proto = 6")
    flags = F.col("tcp_flags")
    syns = tcp.groupBy("dst_ip", at).agg(_sum(scalar.has_flags(flags, 2, 16)).alias("syn"), _sum(scalar.has_flags(flags, 18)).alias("ack")).filter(F.col("syn") >= least)
    r = scalar.ratio(F.col("syn"), F.col("ack"))
    flood = syns.withColumn("r", r).filter(F.col("r") >= ratio).join(even, "bucket").filter(F.col("entropy") >= entropy)
    sure = F.round(F.least(F.lit(0.99), 0.55 + 0.04 * F.least(F.lit(10.0), F.col("r")) + 0.2 * F.col("entropy")), 4)
    flood = flood.select(F.col("dst_ip").alias("subject"), ((F.col("bucket") + 1) * width_us).alias("ts_us"), F.lit("volumetric-ddos").alias("threat_class"), F.lit("syn-flood").alias("subtype"), sure.alias("confidence"))
    wide = probes(packets).groupBy("src_ip", windows.bucket(F.col("ts_us"), wide_us).alias("bucket"), "dst_port").agg(F.count_distinct("dst_ip").alias("h"))
    wide = wide.groupBy("src_ip", "bucket").agg(F.count(F.lit(1)).alias("v"), F.max("h").alias("h")).filter(F.greatest("v", "h") >= fanout)
    scan = wide.select(F.col("src_ip").alias("subject"), ((F.col("bucket") + 1) * wide_us).alias("ts_us"), F.lit("recon-scanning").alias("threat_class"), F.when(F.col("v") >= F.col("h"), "vertical-scan").otherwise("horizontal-scan").alias("subtype"), F.round(F.least(F.lit(0.97), 0.6 + F.greatest("v", "h") / 1000.0), 4).alias("confidence"))
    both = spaced_out(flood.unionByName(scan), ["threat_class", "subject"], "ts_us", gap_us)
    grade = F.when(F.col("threat_class") == "recon-scanning", "MEDIUM").when(F.col("confidence") < 0.9, "HIGH").otherwise("CRITICAL")
    return both.withColumn("severity", grade)


# --- scans


def probes(packets: DataFrame) -> DataFrame:
    """TCP packets with SYN and without ACK; of oriented packets also the first UDP packet of a session."""
    syn = (F.col("proto") == 6) & scalar.has_flags(F.col("tcp_flags"), 2, 16)
    return packets.filter(syn | ((F.col("proto") == 17) & (F.col("nth") == 1)) if "nth" in packets.columns else syn)


def scan_features(packets: DataFrame, scales_us: tuple[int, ...] = (SECOND, 60 * SECOND, 3600 * SECOND)) -> DataFrame:
    """Per source and window of the middle scale: probes, bytes, replies and the widest fan-outs at three scales, each the
    larger of its window and the one before: ports of one host (vertical), hosts on one port (horizontal), and at the
    widest scale all ports and hosts of the source.

    One pass: a probe goes to each scale and side at once, and its distinct values are counted together."""
    mid = scales_us[1]
    p = probes(packets)
    side = lambda scale, kind, key, value: F.struct(F.lit(scale).alias("scale"), F.lit(kind).alias("kind"), windows.bucket(F.col("ts_us"), scales_us[scale]).alias("bucket"), F.col(key).cast("long").alias("key") if key else F.lit(None).cast("long").alias("key"), F.col(value).cast("long").alias("value"))
    sides = [side(k, kind, key, value) for k in range(3) for kind, key, value in (("v", "dst_ip", "dst_port"), ("h", "dst_port", "dst_ip"))] + [side(2, "ports", None, "dst_port"), side(2, "hosts", None, "dst_ip")]
    keys = ["src_ip", "scale", "kind", "key"]
    n = p.select("src_ip", F.explode(F.array(*sides)).alias("e")).select("src_ip", "e.*").groupBy(*keys, "bucket").agg(F.count_distinct("value").alias("n"))
    # the first value of a source may be alone in its window: the window before counts as well
    n = _two(n, keys, "n")
    most = lambda k, kind: F.coalesce(F.max(F.when((F.col("scale") == k) & (F.col("kind") == kind), F.col("n"))), F.lit(0))
    at = F.when(F.col("scale") == 0, scalar.whole(F.col("bucket") * scales_us[0], mid)).otherwise(F.col("bucket"))
    narrow = n.filter("scale < 2").groupBy("src_ip", at.alias("bucket")).agg(most(0, "v").alias("vertical_1"), most(0, "h").alias("horizontal_1"), most(1, "v").alias("vertical_60"), most(1, "h").alias("horizontal_60"))
    wide = n.filter("scale = 2").groupBy("src_ip", F.col("bucket").alias("long")).agg(most(2, "v").alias("vertical_3600"), most(2, "h").alias("horizontal_3600"), most(2, "ports").alias("ports"), most(2, "hosts").alias("hosts"))
    total = p.groupBy("src_ip", windows.bucket(F.col("ts_us"), mid).alias("bucket")).agg(F.sum("packets").alias("probes"), F.sum("length").alias("bytes"))
    tcp = F.col("proto") == 6
    back = packets.filter(tcp).groupBy(F.col("dst_ip").alias("src_ip"), windows.bucket(F.col("ts_us"), mid).alias("bucket")).agg(
        _sum(scalar.has_flags(F.col("tcp_flags"), 18)).alias("syn_ack"), _sum(scalar.has_flags(F.col("tcp_flags"), 4, 2)).alias("rst")
    )
    out = total.join(narrow, ["src_ip", "bucket"]).withColumn("long", scalar.whole(F.col("bucket") * mid, scales_us[2])).join(wide, ["src_ip", "long"]).join(back, ["src_ip", "bucket"], "left").na.fill(0, ["syn_ack", "rst"]).drop("long")
    strobe = F.when(F.col("ports").between(2, 20), scalar.clamp01((F.col("hosts") - 30) / 30.0)).otherwise(0.0)
    return out.withColumns({"completion": scalar.ratio(F.col("syn_ack"), F.col("probes")), "rst_ratio": scalar.ratio(F.col("rst"), F.col("probes")), "bytes_per_probe": F.col("bytes") / F.col("probes"), "strobe": strobe})


def scan_rule(features: DataFrame, ports: int = 30, hosts: int = 30, least: int = 20, bytes_per_probe: float = 120.0, completion: float = 0.3, fast: int = 10, gap: int = 1) -> DataFrame:
    """Windows that look like a scan at the middle or the widest scale, ``gap`` windows apart by source."""
    c = F.col
    base = (c("probes") >= least) & (c("bytes_per_probe") <= bytes_per_probe) & (c("completion") <= completion)
    f = features.withColumns({"vertical": F.greatest("vertical_60", "vertical_3600"), "horizontal": F.greatest("horizontal_60", "horizontal_3600")})
    vertical = (c("vertical") >= ports) & (c("vertical") >= c("horizontal"))
    subtype = F.when(vertical & (c("vertical_1") >= fast), "vertical-scan-fast").when(vertical, "vertical-scan-slow").when((c("horizontal") >= hosts) & (c("strobe") > 0) & (c("ports") > 1), "strobe-scan").when(c("horizontal") >= hosts, "horizontal-sweep")
    return spaced_out(f.filter(base).withColumn("subtype", subtype).filter("subtype IS NOT NULL"), ["src_ip"], "bucket", gap)


# --- exfiltration


def exfil_windows(oriented: DataFrame, width_us: int = 60 * SECOND, alpha: float = 0.2, asymmetric: float = 3.0, sure: float = 0.75, wide_us: int = 3600 * SECOND) -> DataFrame:
    """Per client, server and window of oriented packets whose direction is sure: bytes out and in, running totals, peak,
    asymmetric time, the ratio's moving mean, and how many clients the server had in the wide window or the one before."""
    p = oriented.filter((F.col("orientation_confidence") >= sure) & F.col("proto").isin(6, 17))
    w = windows.tumbling(p, ["client", "server"], "ts_us", width_us, _sum(F.col("outward"), "length").alias("out"), _sum(~F.col("outward"), "length").alias("in"), F.min_by("server_port", "ts_us").alias("port"), F.min_by("proto", "ts_us").alias("proto"), F.min("orientation_confidence").alias("surety"))
    w = w.withColumn("ratio", scalar.ratio(F.col("out"), F.col("in")))
    w = folded(w, ["client", "server"], "bucket", ratio_ewma=folds.ewma_after(F.transform("_w", lambda x: x["ratio"]), alpha))
    run = windows.running(["client", "server"], ["bucket"])
    w = w.withColumns(
        {
            "out_total": F.sum("out").over(run),
            "in_total": F.sum("in").over(run),
            "peak": F.max("out").over(run),
            "sustained_s": F.sum(F.when(F.col("ratio") >= asymmetric, width_us / SECOND).otherwise(0.0)).over(run),
            "age_s": (F.col("bucket") - F.min("bucket").over(run)) * (width_us / SECOND),
            "port": F.first("port").over(run),
            "surety": F.min("surety").over(run),
        }
    )
    fanout = windows.tumbling(p, ["server"], "ts_us", wide_us, F.count_distinct("client").alias("fanout"))
    fanout = _two(fanout, ["server"], "fanout").withColumnRenamed("bucket", "long")
    w = w.withColumn("long", scalar.whole(F.col("bucket") * width_us, wide_us)).join(fanout, ["server", "long"]).drop("long")
    return w.withColumn("novelty", scalar.novelty(F.greatest("fanout", F.lit(1))))


def exfil_rule(rows: DataFrame, ratio: float = 3.0, least_bytes: float = 100_000, sustained_s: float = 300, burst_bytes: float = 5_000_000, gap: int = 10, allowlist: DataFrame | None = None) -> DataFrame:
    """One-sided transfers, ``gap`` windows apart.  ``reason``: why a row is no alert (its server and port are in the
    allowlist: cidr, ports, reason, rank); such rows do not start a cooldown."""
    from flowmill.operators.joins import cidr_join

    hit = (F.col("ratio_ewma") >= ratio) & (F.col("out_total") >= least_bytes) & (F.col("sustained_s") >= sustained_s)
    hits = rows.filter(hit).withColumn("subtype", F.when(F.col("peak") >= burst_bytes, "upload-burst").otherwise("slow-drip-upload"))
    if allowlist is None:
        return spaced_out(hits, ["client", "server"], "bucket", gap).withColumn("reason", F.lit(None).cast("string"))
    known = cidr_join(hits, allowlist, "server", "port")
    quiet = known.filter("reason IS NOT NULL").withColumn("reason", F.lit("exfil-allowlist"))
    return spaced_out(known.filter("reason IS NULL"), ["client", "server"], "bucket", gap).unionByName(quiet)


# --- names


def dns_sources(queries: DataFrame, width_us: int = 300 * SECOND) -> DataFrame:
    """Per source and window; domains are those of two generations.  queries: src_ip (the asker), ts_us, is_response, rcode,
    answers, qtype, domain, score.  Scores are added in the order of time, so that a mean at a threshold falls on the same
    side however the rows are dealt out."""
    ask, answer = ~F.col("is_response"), F.col("is_response")
    one = F.lit(1)
    w = Window.partitionBy("src_ip", "bucket").orderBy("ts_us", "score")
    added = F.sum(F.when(ask, F.col("score").cast("double"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    dated = queries.withColumn("bucket", windows.bucket(F.col("ts_us"), width_us))
    f = dated.withColumns({"_added": added, "_at": F.row_number().over(w)}).groupBy("src_ip", "bucket").agg(
        _sum(ask, one).alias("queries"),
        _sum(answer, one).alias("responses"),
        _sum(answer & (F.col("rcode") == 3), one).alias("nx"),
        _sum(answer & (F.col("rcode") != 3) & (F.col("answers") == 0), one).alias("empty"),
        _sum(ask & F.col("qtype").isin(16, 10), one).alias("txt_null"),
        F.count_distinct(F.when(ask, F.col("domain"))).alias("domains"),
        (F.max_by("_added", "_at") / F.nullif(F.count(F.when(ask, F.col("score"))), F.lit(0))).alias("mean_score"),
    )
    f = _two(f, ["src_ip"], "domains")
    return f.withColumns({"nx_ratio": scalar.ratio(F.col("nx"), F.col("responses")), "empty_ratio": scalar.ratio(F.col("empty"), F.col("responses"))})


def dga_rule(rows: DataFrame, domains: int = 20, queries: int = 30, score: float = 0.55, nx: float = 0.5) -> DataFrame:
    kind = F.when(F.col("mean_score") >= score, "dga-high-entropy").when(F.col("nx_ratio") >= nx, "dga-dictionary")
    return rows.filter((F.col("domains") >= domains) & (F.col("queries") >= queries)).withColumn("subtype", kind).filter("subtype IS NOT NULL")


def dns_zones(queries: DataFrame, width_us: int = 300 * SECOND, alpha: float = 0.05) -> DataFrame:
    """Per source, zone and window: distinct names (of two generations), share of TXT and NULL, the excess of the names over
    earlier windows and the change of the share."""
    w = windows.tumbling(
        queries.filter(~F.col("is_response")), ["src_ip", "domain"], "ts_us", width_us, F.count(F.lit(1)).alias("queries"), F.count_distinct("qname").alias("names"), F.sum(F.col("qtype").isin(16, 10).cast("int")).alias("txt")
    )
    w = _two(w, ["src_ip", "domain"], "names").withColumn("txt_ratio", scalar.ratio(F.col("txt"), F.col("queries")))
    before = lambda name: folds.ewma_before(F.transform("_w", lambda x: x[name]), alpha)
    w = folded(w, ["src_ip", "domain"], "bucket", baseline=before("names"), _txt=before("txt_ratio"), windows=F.transform("_w", lambda _, i: i))
    return w.withColumns({"excess": F.when(F.col("baseline") > 0, F.col("names") / F.col("baseline")).otherwise(1.0), "txt_dev": F.col("txt_ratio") - F.col("_txt")}).drop("_txt")


def tunnel_rule(rows: DataFrame, names: int = 50, excess: float = 4.0, txt: float = 0.3, learned: int = 2, wildcards: DataFrame | None = None) -> DataFrame:
    """Zones that carry a tunnel.  ``reason``: why a row is no alert (its zone is, or lies below, one of ``wildcards``)."""
    from flowmill.operators.joins import suffix_join

    hits = rows.filter((F.col("names") >= names) & ((F.col("windows") < learned) | (F.col("excess") >= excess)) & (F.col("txt_ratio") >= txt)).withColumn("subtype", F.lit("dns-tunnel-txt-null"))
    if wildcards is None:
        return hits.withColumn("reason", F.lit(None).cast("string"))
    return suffix_join(hits, wildcards, "domain", "domain").withColumn("reason", F.when(F.col("matched").isNotNull(), "cdn-wildcard-allowlist")).drop("matched")


# --- fingerprints


def pair_outliers(hellos: DataFrame, ja4: str, family: str, order: list[str], least: int = 20, share: float = 0.15) -> DataFrame:
    """hellos with running counts of the fingerprint and its pair with a family, and whether the pair is an outlier."""
    each, pair = windows.running([ja4], order), windows.running([ja4, family], order)
    h = hellos.withColumns({"ja4_count": F.count(F.lit(1)).over(each), "pair_count": F.count(F.lit(1)).over(pair)})
    h = h.withColumn("pair_share", F.col("pair_count") / F.col("ja4_count"))
    return h.withColumn("outlier", (F.col("ja4_count") >= least) & (F.col("pair_share") <= share))


def consistency(family: Column, expected: Column, known: Column) -> Column:
    """1 where the family is among the expected, 0 where it is not, 0.5 where the fingerprint is unknown."""
    return F.when(~known, 0.5).when(F.array_contains(expected, family), 1.0).otherwise(0.0)


# --- beacons


def beacon_starts(oriented: DataFrame, tie: str, least_packets: int = 4, most_bytes: float = 1200.0, least_s: float = 1.0, short_gaps: int = 3) -> DataFrame:
    """Session starts of channels (proto, client, server, server_port) that may be beacons: at that time the channel has at
    least ``least_packets`` packets, small on average and on average ``least_s`` apart, and its last ``short_gaps`` gaps
    under ``least_s`` began it anew.  ``epoch`` numbers those beginnings."""
    from flowmill.operators.flows import session_start

    channel = ["proto", "client", "server", "server_port"]
    run = windows.running(channel, ["ts_us", tie])
    p = oriented.filter(F.col("proto").isin(6, 17)).withColumns({"_n": F.sum("packets").over(run), "_bytes": F.sum("length").over(run), "_span": F.col("ts_us") - F.min("ts_us").over(run)})
    ok = (F.col("_n") >= least_packets) & (F.col("_bytes") / F.col("_n") <= most_bytes) & (F.col("_span") / (F.col("_n") - 1) >= least_s * SECOND)
    s = windows.gaps(p.filter(session_start() & ok).select(*channel, "ts_us", tie), channel, "ts_us", tie)
    short = F.sum(F.when((F.col("gap") > 0) & (F.col("gap") < least_s * SECOND), 1).otherwise(0)).over(run)
    s = s.withColumn("_short", short).withColumn("epoch", F.coalesce(F.floor(F.lag("_short").over(Window.partitionBy(*channel).orderBy("ts_us", tie)) / short_gaps), F.lit(0)))
    return s.drop("_short", "gap")


def latest_epoch(starts: DataFrame, keys: list[str]) -> DataFrame:
    return starts.withColumn("_e", F.max("epoch").over(Window.partitionBy(*keys))).filter("epoch = _e").drop("_e")


def beacon_features(starts: DataFrame, keys: list[str], ts: str, tie: str, last: int = 64, least: int = 12) -> DataFrame:
    """Statistics of a channel's last gaps between session starts, gaps under a second left out."""
    g = windows.gaps(starts, keys, ts, tie).filter(F.col("gap") >= SECOND)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc()))
    x = F.col("gap") / SECOND
    return g.withColumn("rn", rn).filter(F.col("rn") <= last).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(x).alias("span"), F.avg(x).alias("iat_mean"), F.stddev_pop(x).alias("iat_std"), (F.stddev_pop(x) / F.avg(x)).alias("iat_cv"), F.skewness(x).alias("iat_skew"), F.kurtosis(x).alias("iat_kurtosis")
    ).filter(F.col("samples") >= least)


def periodogram(times: np.ndarray, values: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Normalised Lomb-Scargle power of values (their mean removed) at each frequency."""
    if len(times) < 3 or not len(freqs):
        return np.zeros(len(freqs))
    y = values - values.mean()
    spread = y.var(ddof=1)
    if spread <= 0:
        return np.zeros(len(freqs))
    out = np.empty(len(freqs))
    for k, f in enumerate(freqs):
        angle = 2 * np.pi * f * times
        shift = 0.5 * np.arctan2(np.sin(2 * angle).sum(), np.cos(2 * angle).sum())
        c, s = np.cos(angle - shift), np.sin(angle - shift)
        cc, ss = c @ c, s @ s
        out[k] = ((c @ y) ** 2 / cc if cc > 1e-12 else 0) + ((s @ y) ** 2 / ss if ss > 1e-12 else 0)
    return out / (2 * spread)


def peak_period(arrivals: np.ndarray, bins: int = 4096, frequencies: int = 512) -> tuple[float, float]:
    """(period, power) of the strongest frequency of an event train; (0, 0) where it cannot be told.  A harmonic gives
    way to its fundamental if that holds half its power."""
    if len(arrivals) < 4:
        return 0.0, 0.0
    t = np.sort(np.asarray(arrivals, float))
    t = t - t[0]
    gap = np.diff(t)
    step, span, short = np.median(gap) / 8, t[-1], np.quantile(gap, 0.1)
    if step <= 0 or span <= 0 or short <= 0 or int(np.ceil(span / step)) + 1 > bins:
        return 0.0, 0.0
    n = int(np.ceil(span / step)) + 1
    train = np.bincount(np.minimum((t / step).astype(int), n - 1), minlength=n).astype(float)
    low, high = 2.0 / span, 1.0 / (0.9 * short)
    if high <= low:
        return 0.0, 0.0
    freqs = np.geomspace(low, high, frequencies)
    power = periodogram(np.arange(n) * step, train, freqs)
    best = int(power.argmax())
    for k in (4, 3, 2):
        near = np.flatnonzero(np.abs(freqs - freqs[best] / k) <= 0.05 * freqs[best] / k)
        if len(near) and power[near].max() >= 0.5 * power[best]:
            best = int(near[power[near].argmax()])
            break
    return float(1 / freqs[best]), float(power[best])


def beacon_periods(starts: DataFrame, keys: list[str], ts: str, tie: str, last: int = 65) -> DataFrame:
    """(keys, period, power, fap) of the last ``last`` session starts; only those reach Python, ranked before."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc()))
    arrays = starts.withColumn("_rn", rn).filter(F.col("_rn") <= last).groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(ts) / SECOND)).alias("_a")).filter(F.size("_a") >= 4)

    @F.pandas_udf("struct<period: double, power: double>")
    def peak(a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([peak_period(x) for x in a], columns=["period", "power"])

    p = arrays.withColumn("_p", peak("_a")).select(*keys, "_p.period", "_p.power")
    return p.withColumn("fap", scalar.false_alarm_probability(F.col("power")))


def channel_features(starts: DataFrame, keys: list[str], ts: str, tie: str, by: tuple[str, ...], last: int = 64, least: int = 12) -> DataFrame:
    """Statistics and strongest period of a channel's last gaps of a second and more, the time of its last start and one
    over the destinations of its source, from one pass over the session starts.  by: the source, and what tells its
    destinations apart, all of them keys."""
    g = windows.gaps(starts, keys, ts, tie).withColumn("_ok", F.coalesce(F.col("gap") >= SECOND, F.lit(False)))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_ok").desc(), F.col(ts).desc(), F.col(tie).desc()))
    x = F.when(F.col("_ok") & (rn <= last), F.col("gap") / SECOND)
    rows = g.withColumn("_x", x)
    x = F.col("_x")
    c = rows.groupBy(*keys).agg(
        F.count(x).alias("beacon_sample_count"), F.sum(x).alias("beacon_span_s"), F.avg(x).alias("iat_mean"), F.stddev_pop(x).alias("iat_std"), (F.stddev_pop(x) / F.avg(x)).alias("iat_cv"), F.skewness(x).alias("iat_skew"), F.kurtosis(x).alias("iat_kurtosis"),
        F.max(ts).alias("last_us"), F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(ts, tie, "_x")))), lambda e: e["_x"]).alias("_gaps"),
    )
    src, *dst = by
    one = F.row_number().over(Window.partitionBy(*by).orderBy(*[k for k in keys if k not in by] or [src]))
    fan = F.sum(F.when(F.col("_one") == 1, 1).otherwise(0)).over(Window.partitionBy(src))
    c = c.withColumn("_one", one).withColumn("dst_stability", 1.0 / fan).filter(F.col("beacon_sample_count") >= least)

    @F.pandas_udf("struct<period: double, power: double>")
    def peak(a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([peak_period(np.concatenate([[0.0], np.cumsum(x)])) for x in a], columns=["period", "power"])

    c = c.withColumn("_p", peak("_gaps")).withColumns({"ls_peak_period_s": F.col("_p.period"), "ls_peak_power": F.col("_p.power"), "ls_fap": scalar.false_alarm_probability(F.col("_p.power"))})
    return c.drop("_one", "_gaps", "_p")


# --- novelty


def novelty_windows(packets: DataFrame, keys: list[str], width_us: int = 5 * SECOND, least: int = 4) -> DataFrame:
    """Per flow and window: the counts, sizes and rates that the rarity model reads."""
    fwd = F.col("forward")
    w = windows.tumbling(
        packets,
        keys,
        "ts_us",
        width_us,
        ((F.max("ts_us") - F.min("ts_us")) / SECOND).alias("window_duration_s"),
        _sum(fwd).alias("packets_fwd"),
        _sum(~fwd).alias("packets_rev"),
        _sum(fwd, "length").alias("bytes_fwd"),
        _sum(~fwd, "length").alias("bytes_rev"),
    ).withColumn("packets", F.col("packets_fwd") + F.col("packets_rev"))
    seconds = F.greatest(F.col("window_duration_s"), F.lit(1e-6))
    size = F.col("bytes_fwd") + F.col("bytes_rev")
    return w.filter(F.col("packets") >= least).withColumns(
        {"packet_rate": F.col("packets") / seconds, "byte_rate": size / seconds, "mean_packet_size": size / F.col("packets"), "reverse_packet_share": F.col("packets_rev") / F.col("packets"), "completeness_flag": ((F.col("packets_fwd") > 0) & (F.col("packets_rev") > 0)).cast("double")}
    )


def persistence(rows: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """rows with ``in_a_row``: windows of the key so far with no more than ``most`` windows between neighbours."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    new = (F.col("bucket") - F.lag("bucket").over(w) > most).cast("int")
    r = rows.withColumn("_g", F.coalesce(new, F.lit(0)))
    r = r.withColumn("_g", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.withColumn("in_a_row", F.row_number().over(Window.partitionBy(*keys, "_g").orderBy("bucket"))).drop("_g")


# --- encrypted sessions


def fingerprint_reference(hellos: DataFrame, ja4: str = "ja4", host: str = "src_ip", family: str = "family", order: str = "ts_us") -> DataFrame:
    """(ja4, family, hosts, agreeing, confidence): the commonest family by fingerprint, each host counted once by its
    first hello."""
    first = hellos.groupBy(ja4, host).agg(F.min_by(family, order).alias("family"))
    n = first.groupBy(ja4, "family").agg(F.count(F.lit(1)).alias("agreeing"))
    total = n.groupBy(ja4).agg(F.sum("agreeing").alias("hosts"), F.max_by(F.struct("family", "agreeing"), F.struct("agreeing", "family")).alias("_b"))
    return total.select(ja4, F.col("_b.family").alias("family"), "hosts", F.col("_b.agreeing").alias("agreeing"), (F.col("_b.agreeing") / F.col("hosts")).alias("confidence"))


def encrypted_rule(packets: DataFrame, reference: DataFrame, order: list[str], least: int = 20, share: float = 0.15, gap: int = 300 * SECOND) -> DataFrame:
    """Client hellos whose fingerprint disagrees with the host's TCP stack, or whose pairing is rare, ``gap`` apart by host.

    packets: ts_us, src_ip, flow (any key), tcp_print (empty but for SYNs), ja4 (null but for hellos).  A hello takes the
    latest TCP fingerprint of its flow, else of its host; without one it is no alert (``reason``).  reference: ja4, expected
    (array of families), and where known confidence and support; broadcast if it is counted small."""
    from flowmill.operators.joins import is_small, last_known

    p = packets.withColumn("_fp", F.when(F.col("tcp_print") != "", F.col("tcp_print")))
    seen = p.filter("_fp IS NOT NULL")
    runs = windows.repeats(seen.select("src_ip", *order, "_fp"), ["src_ip"], order, "_fp").withColumnRenamed("run", "_run")
    p = p.join(runs, ["src_ip", *order, "_fp"], "left")
    h = last_known(p, ["flow"], ["src_ip"], order, "_fp")
    h = h.withColumn("repeats", F.coalesce(F.last("_run", ignorenulls=True).over(windows.running(["src_ip"], order)), F.lit(0))).filter(F.col("ja4").isNotNull())
    bare = h.filter("known IS NULL").withColumn("reason", F.lit("no-syn-observed"))
    h = h.filter("known IS NOT NULL").withColumn("family", scalar.fingerprint_family(F.col("known")))
    r = reference.select("ja4", "expected", *[(F.col(c) if c in reference.columns else F.lit(0)).cast("double").alias(c) for c in ("confidence", "support")])
    h = pair_outliers(h, "ja4", "family", order, least, share).join(F.broadcast(r) if is_small(r) else r, "ja4", "left")
    h = h.withColumn("consistency", consistency(F.col("family"), F.col("expected"), F.col("expected").isNotNull()))
    subtype = F.when(F.col("consistency") == 0, "ja4-tcp-fingerprint-disagreement").when((F.col("consistency") == 0.5) & F.col("outlier"), "ja4-tcp-pairing-outlier")
    hits = h.withColumn("subtype", subtype).filter("subtype IS NOT NULL").drop("_fp", "_run", "known", "expected")
    out = spaced_out(hits, ["src_ip"], "ts_us", gap, *order)
    return out.withColumn("reason", F.lit(None).cast("string")).unionByName(bare.drop("_fp", "_run", "known"), allowMissingColumns=True)


# --- exports and decisions


def flow_export(packets: DataFrame, keys: list[str], idle_us: int = 60 * SECOND, active_us: int = 120 * SECOND) -> DataFrame:
    """Records as an exporter cuts them: a record ends after ``idle_us`` without a packet, or ``active_us`` after its start.

    The idle cut is a window; within an idle run the active cut depends on the cuts before, so the run's distinct
    seconds are folded in order."""
    runs = windows.sessions(packets, keys, "ts_us", idle_us, F.array_sort(F.collect_set(F.floor(F.col("ts_us") / SECOND).cast("long"))).alias("_s"))
    starts = runs.select(*keys, "session", F.explode(folds.cooldown(F.col("_s"), active_us // SECOND)).alias("start"))
    w = Window.partitionBy(*keys).orderBy("ts_us")
    p = packets.withColumn("session", (F.col("ts_us") - F.lag("ts_us").over(w) >= idle_us).cast("int")).withColumn("session", F.sum(F.coalesce("session", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = p.select(*keys, "session", F.floor(F.col("ts_us") / SECOND).cast("long").alias("second"), "ts_us", "packets", "length", "tcp_flags", F.lit(None).cast("long").alias("start"))
    marks = starts.select(*keys, "session", F.col("start").alias("second"), F.lit(None).cast("long").alias("ts_us"), F.lit(0).alias("packets"), F.lit(0).cast("long").alias("length"), F.lit(0).alias("tcp_flags"), "start")
    at = Window.partitionBy(*keys, "session").orderBy("second", F.col("start").isNull(), "ts_us").rowsBetween(Window.unboundedPreceding, 0)
    r = both.unionByName(marks).withColumn("start", F.last("start", ignorenulls=True).over(at)).filter("ts_us IS NOT NULL")
    return r.groupBy(*keys, "session", "start").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.sum("packets").alias("packets"), F.sum("length").alias("bytes"), F.bit_or("tcp_flags").alias("tcp_flags")).drop("session", "start")


def supported(cls: Column, features: dict[str, Column], least_bytes: float = 100_000) -> Column:
    """Whether an observation carries the least that its class can be told by."""
    f = {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in features.items()}
    more = lambda k, than=0.0: f.get(k, F.lit(0.0)) > than
    at_least = lambda k, n: f.get(k, F.lit(0.0)) >= n
    compared = features["fingerprint_consistency_score"].isNotNull() if "fingerprint_consistency_score" in features else F.lit(False)
    mostly_udp = at_least("udp_packet_share", 0.8)
    needs = {
        "volumetric-ddos": more("pps_to_dst_ewma_dev") & (more("syn_synack_ratio_1s", 1) | (mostly_udp & (at_least("reflection_service_share", 0.8) | at_least("entropy_explosion_score", 0.5)))),
        "c2-beaconing": at_least("beacon_sample_count", 3) & more("ls_peak_period_s"),
        "dga-dns-tunnelling": more("source_query_count_300s", 1) & (more("distinct_regdom_300s", 1) | (more("subdomain_cardinality", 1) & more("qtype_txt_null_ratio"))),
        "encrypted-malware": more("tls_version") & more("ja4_observation_count") & compared,
        "recon-scanning": more("scan_probe_count_60s", 1),
        "data-exfiltration": at_least("outbound_bytes_total", least_bytes) & more("out_in_ratio_ewma", 1),
    }
    out = F.lit(False)
    for name, need in needs.items():
        out = F.when(cls == name, need).otherwise(out)
    return out


def model_alerts(scored: DataFrame, subject: str, ts: str, least: float = 0.99, rarity: float = 0.5, gap: int = 600 * SECOND, window: int = 600 * SECOND, most: int = 3) -> DataFrame:
    """Alerts of the model alone.  scored: subject, ts, label, p, rarity, ruled (a rule fired on it), supported.

    The gates on one row come first, then the cooldown of a subject, then the quota of a class; both fold over ordered
    times of the few rows that are left."""
    ok = scored.filter((~F.col("ruled")) & (F.col("label") != "benign") & (F.col("p") >= least) & F.col("supported") & (F.col("rarity") >= rarity))
    cool = cooled(ok, [subject, "label"], ts, gap)
    q = cool.groupBy("label").agg(F.array_sort(F.collect_set(F.col(ts))).alias("_t")).select("label", F.explode(folds.quota(F.col("_t"), window, most)).alias(ts))
    return ok.join(cool.join(q, ["label", ts]), [subject, "label", ts])


def enriched(detections: DataFrame, least: float = 0.5) -> DataFrame:
    """Rule detections (confidence, severity, threat_class) with the model's confidence where label and p agree."""
    agree = (F.col("label") == F.col("threat_class")) & (F.col("p") >= least) & ~F.coalesce("extended", F.lit(False))
    conf = F.when(agree, F.greatest("confidence", "p")).otherwise(F.col("confidence"))
    return detections.withColumns({"confidence": conf, "severity": F.when(agree, scalar.severity(conf)).otherwise(F.col("severity")), "source": F.when(agree, "ensemble").otherwise(F.col("source"))})
