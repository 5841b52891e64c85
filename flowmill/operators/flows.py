"""Flows: direction-free grouping, orientation, structural and sequence features, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import scalar

SPLT = 20


def keyed(packets: DataFrame) -> DataFrame:
    """packets with lo_ip, lo_port, hi_ip, hi_port and ``forward`` (source is the lower end)."""
    key, forward = scalar.flow_key(F.col("proto"), F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    k = packets.withColumn("_k", key).withColumn("forward", forward)
    return k.select("*", F.col("_k.lo.ip").alias("lo_ip"), F.col("_k.lo.port").alias("lo_port"), F.col("_k.hi.ip").alias("hi_ip"), F.col("_k.hi.port").alias("hi_port")).drop("_k")


KEY = ["proto", "lo_ip", "lo_port", "hi_ip", "hi_port"]


def sessions(packets: DataFrame, idle_us: int, tie: str) -> DataFrame:
    """packets with ``session``: a flow's number of idle gaps of at least ``idle_us`` before the packet."""
    w = Window.partitionBy(*KEY).orderBy("ts_us", tie)
    opens = (F.col("ts_us") - F.lag("ts_us").over(w) >= idle_us).cast("int")
    return keyed(packets).withColumn("_open", F.coalesce(opens, F.lit(0))).withColumn("session", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")


def _flag(on: int, off: int = 0) -> Column:
    return scalar.has_flags(F.col("tcp_flags"), on, off) & (F.col("proto") == 6)


def _initiator(last_syn: Column, last_syn_ack: Column, first: Column) -> tuple[Column, Column]:
    """(whether the lower end began the session, how surely): a SYN's source, a SYN-ACK's destination, else by port, else
    by the higher port of the first packet.  first: struct (src_port, dst_port, forward)."""
    by_port, sure = scalar.guessed_initiator(first["src_port"], first["dst_port"])
    guess = F.when(by_port, first["forward"]).otherwise(~first["forward"])
    return F.coalesce(last_syn["lo"], last_syn_ack["lo"], guess), F.when(last_syn.isNotNull() | last_syn_ack.isNotNull(), 1.0).otherwise(sure)


def flow_table(packets: DataFrame, idle_us: int = 120_000_000, tie: str = "event_id") -> DataFrame:
    """One row a flow session.  The initiator is resolved first, then packets and bytes are summed by direction: one shuffle
    for both.  saw_*: whether a SYN, SYN-ACK, FIN or RST was seen."""
    p = sessions(packets, idle_us, tie)
    n, size, fwd = F.col("packets"), F.col("length"), F.col("forward")
    seen = F.bit_or(F.when(F.col("proto") == 6, F.col("tcp_flags")).otherwise(0))
    f = p.groupBy(*KEY, "session").agg(
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.sum(F.when(fwd, n).otherwise(0)).alias("pkts_lo"),
        F.sum(F.when(~fwd, n).otherwise(0)).alias("pkts_hi"),
        F.sum(F.when(fwd, size).otherwise(0)).alias("bytes_lo"),
        F.sum(F.when(~fwd, size).otherwise(0)).alias("bytes_hi"),
        seen.alias("flags_seen"),
        F.bool_or(_flag(2, 16)).alias("saw_syn"),
        F.bool_or(_flag(18)).alias("saw_syn_ack"),
        F.bool_or(_flag(1)).alias("saw_fin"),
        F.bool_or(_flag(4)).alias("saw_rst"),
        F.max(F.when(_flag(2, 16), F.struct("ts_us", tie, fwd.alias("lo")))).alias("last_syn"),
        F.max(F.when(_flag(18), F.struct("ts_us", tie, (~fwd).alias("lo")))).alias("last_syn_ack"),
        F.min(F.struct("ts_us", tie, "src_port", "dst_port", "forward")).alias("first"),
    )
    lo, sure = _initiator(F.col("last_syn"), F.col("last_syn_ack"), F.col("first"))
    f = f.withColumn("initiator_is_lo", lo).withColumn("orientation_confidence", sure)
    up = lambda a, b: F.when(F.col("initiator_is_lo"), F.col(a)).otherwise(F.col(b))
    return f.select(
        *KEY,
        "session",
        "first_us",
        ((F.col("last_us") - F.col("first_us")) / 1e6).alias("duration"),
        up("pkts_lo", "pkts_hi").alias("pkts_fwd"),
        up("pkts_hi", "pkts_lo").alias("pkts_rev"),
        up("bytes_lo", "bytes_hi").alias("bytes_fwd"),
        up("bytes_hi", "bytes_lo").alias("bytes_rev"),
        F.col("flags_seen").alias("flags_seen_bitmap"),
        "saw_syn",
        "saw_syn_ack",
        "saw_fin",
        "saw_rst",
        "initiator_is_lo",
        "orientation_confidence",
        ((F.col("pkts_lo") > 0) & (F.col("pkts_hi") > 0)).alias("completeness_flag"),
    )


def oriented(packets: DataFrame, idle_us: int = 120_000_000, tie: str = "event_id") -> DataFrame:
    """packets with client, server, their ports, ``outward`` (sent by the client), orientation_confidence and ``nth`` (place
    in the session), by the session's initiator as in ``flow_table``: one shuffle by flow, no join."""
    p = sessions(packets, idle_us, tie)
    whole = Window.partitionBy(*KEY, "session")
    last = lambda cond, lo: F.max(F.when(cond, F.struct("ts_us", tie, lo.alias("lo")))).over(whole)
    fwd = F.col("forward")
    p = p.withColumns({"_syn": last(_flag(2, 16), fwd), "_ack": last(_flag(18), ~fwd), "_first": F.min(F.struct("ts_us", tie, "src_port", "dst_port", "forward")).over(whole), "nth": F.row_number().over(whole.orderBy("ts_us", tie))})
    lo, sure = _initiator(F.col("_syn"), F.col("_ack"), F.col("_first"))
    out = p.withColumns({"outward": lo == fwd, "orientation_confidence": sure}).drop("_syn", "_ack", "_first")
    side = lambda a, b: F.when(F.col("outward"), F.col(a)).otherwise(F.col(b))
    return out.withColumns({"client": side("src_ip", "dst_ip"), "server": side("dst_ip", "src_ip"), "client_port": side("src_port", "dst_port"), "server_port": side("dst_port", "src_port")})


def channels(oriented_: DataFrame) -> DataFrame:
    """One row a channel (proto, client, server, server_port): packets and bytes by direction, the last time."""
    out, n, size = F.col("outward"), F.col("packets"), F.col("length")
    part = lambda on, v: F.sum(F.when(on, v).otherwise(0)).cast("long")
    return oriented_.groupBy("proto", "client", "server", "server_port").agg(part(out, n).alias("pkts_fwd"), part(~out, n).alias("pkts_rev"), part(out, size).alias("bytes_fwd"), part(~out, size).alias("bytes_rev"), F.max("ts_us").alias("last_us"))


def session_start() -> Column:
    """Of oriented packets: a TCP SYN without ACK, or the first UDP packet of a session."""
    return _flag(2, 16) | ((F.col("proto") == 17) & (F.col("nth") == 1))


def structural(flows: DataFrame) -> DataFrame:
    """flows with the per-packet averages and the direction label."""
    per = lambda b, n: F.when(F.col(n) > 0, F.col(b) / F.col(n)).otherwise(0.0)
    label = F.when(F.col("completeness_flag"), "BIDIRECTIONAL").when(F.col("pkts_fwd") > 0, "FWD_ONLY").otherwise("REV_ONLY")
    return flows.withColumns({"bytes_per_pkt_fwd": per("bytes_fwd", "pkts_fwd"), "bytes_per_pkt_rev": per("bytes_rev", "pkts_rev"), "directionality": label})


def coverage_class(flows: DataFrame, ja4: Column | None = None) -> Column:
    """How much of a flow can be judged: quic, opaque, high or low."""
    has = lambda p: (F.col("lo_port") == p) | (F.col("hi_port") == p)
    tls = has(443) | has(8443) | has(853)
    known = ja4.isNotNull() if ja4 is not None else F.lit(False)
    return F.when((F.col("proto") == 17) & has(443), "quic").when(tls & F.col("completeness_flag") & ~known, "opaque").when(F.col("completeness_flag") & (F.col("orientation_confidence") >= 1.0), "high").otherwise("low")


def sequence_features(packets: DataFrame, keys: list[str], order: list[str], signed_length: Column, n: int = SPLT) -> DataFrame:
    """Features of a key's first n signed lengths and gaps (the first gap left out of the gap statistics)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = packets.withColumn("_len", signed_length).withColumn("_gap", F.col(order[0]) - F.lag(order[0]).over(w)).withColumn("_rn", F.row_number().over(w)).withColumn("_turn", (F.signum("_len") != F.signum(F.lag("_len").over(w))).cast("int")).filter(F.col("_rn") <= n)
    size, up, down = F.abs("_len"), F.sum(F.when(F.col("_len") > 0, F.col("_len")).otherwise(0)), F.sum(F.when(F.col("_len") < 0, -F.col("_len")).otherwise(0))
    cv = lambda c: F.when(F.avg(c) != 0, F.stddev_pop(c) / F.avg(c)).otherwise(0.0)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("splt_len"),
        F.avg(size).alias("splt_mean_abs_len"),
        cv(size).alias("splt_len_cv"),
        F.coalesce(F.avg("_gap"), F.lit(0.0)).alias("splt_iat_mean"),
        F.coalesce(cv("_gap"), F.lit(0.0)).alias("splt_iat_cv"),
        F.when(down > 0, up / down).otherwise(up.cast("double")).alias("splt_up_down_ratio"),
        F.coalesce(F.sum("_turn"), F.lit(0)).alias("splt_direction_changes"),
    )
