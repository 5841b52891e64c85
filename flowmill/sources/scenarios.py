"""Deterministic synthetic traffic: background and attacks as expressions over ``spark.range``; a seed and an id give
every value, so a row is the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_US = 1_788_775_200_000_000
SECOND = 1_000_000
WEB, RESOLVER = (10 << 24) | (20 << 16) | (4 << 8) | 17, (10 << 24) | (20 << 16) | 53


#: TLS clients and the TCP stacks that go with them: (client fingerprint, TCP fingerprint).
CHROME_WINDOWS = ("t13d1516h2_8daaf6152771_50f4c41e1dde", "128:65535:1460:mss,nop,ws,nop,nop,sok")
FIREFOX_LINUX = ("t13d1714h2_5b57614c22b0_280534f07fee", "64:64240:1460:mss,sok,ts,nop,ws")


def _unit(seed: int, salt: int) -> Column:
    """Uniform in [0, 1) from the row's id."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def _pick(seed: int, salt: int, n: int) -> Column:
    return F.floor(_unit(seed, salt) * n).cast("long")


def _packets(spark: SparkSession, n: int, **columns: Column | int) -> DataFrame:
    base = {"proto": 6, "src_port": 0, "dst_port": 0, "length": 60, "tcp_flags": 16, "packets": 1, "scenario": "benign"}
    values = base | columns
    return spark.range(n).select("id", *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])


def _at(seed: int, start: float, length: float) -> Column:
    return (F.lit(BASE_US) + F.floor((start + _unit(seed, 1) * length) * SECOND)).cast("long")


def background(spark: SparkSession, seed: int, seconds: int = 300, rate: int = 27) -> DataFrame:
    """Forty hosts with many servers: both directions, answered handshakes, no key above a few packets a second."""
    host = F.lit((10 << 24) | (20 << 16) | (1 << 8) | 10) + _pick(seed, 2, 40)
    server = F.lit((93 << 24) | (184 << 16)) + _pick(seed, 3, 60)
    out = F.col("id") % 2 == 0
    port = (40_000 + _pick(seed, 4, 20_000)).cast("int")
    kind = F.pmod(F.floor(F.col("id") / 2), F.lit(8))
    flags = F.when(kind == 0, F.when(out, 2).otherwise(18)).when(kind == 7, 17).otherwise(16)
    return _packets(spark, seconds * rate, ts_us=_at(seed, 0, seconds), src_ip=F.when(out, host).otherwise(server), dst_ip=F.when(out, server).otherwise(host), src_port=F.when(out, port).otherwise(443), dst_port=F.when(out, 443).otherwise(port), tcp_flags=flags, length=60 + _pick(seed, 5, 900))


def syn_flood(spark: SparkSession, seed: int, start: int = 60, seconds: int = 60, rate: int = 160) -> DataFrame:
    """SYNs from three thousand sources to one web server; the server answers one in twelve."""
    answer = F.col("id") % 13 == 12
    src = F.lit(167 << 24) + _pick(seed, 2, 3000) * 977
    port = (1024 + _pick(seed, 3, 60_000)).cast("int")
    return _packets(spark, seconds * rate, ts_us=_at(seed, start, seconds), src_ip=F.when(answer, F.lit(WEB)).otherwise(src), dst_ip=F.when(answer, src).otherwise(F.lit(WEB)), src_port=F.when(answer, 443).otherwise(port), dst_port=F.when(answer, port).otherwise(443), tcp_flags=F.when(answer, 18).otherwise(2), length=F.lit(44), scenario="syn_flood")


def port_scan(spark: SparkSession, seed: int, start: int = 120, ports: int = 1024, seconds: int = 9) -> DataFrame:
    """One source to a thousand ports of one host, unanswered."""
    return _packets(spark, ports, ts_us=(F.lit(BASE_US + start * SECOND) + F.floor(F.col("id") * (seconds * SECOND / ports))).cast("long"), src_ip=F.lit((10 << 24) | (20 << 16) | (3 << 8) | 15), dst_ip=F.lit(WEB), src_port=(50_000 + F.col("id") % 10_000).cast("int"), dst_port=(F.col("id") + 1).cast("int"), tcp_flags=2, length=F.lit(44), scenario="port_scan")


def beacon(spark: SparkSession, seed: int, period: float = 45.0, jitter: float = 0.3, starts: int = 70) -> DataFrame:
    """Check-ins of one host to one server every ``period`` seconds, give or take."""
    at = (F.lit(BASE_US) + F.floor((F.col("id") + 1 + (_unit(seed, 1) - 0.5) * jitter) * period * SECOND)).cast("long")
    return _packets(spark, starts, ts_us=at, src_ip=F.lit((10 << 24) | (20 << 16) | (2 << 8) | 11), dst_ip=F.lit((203 << 24) | (113 << 8) | 77), src_port=F.lit(50_000), dst_port=F.lit(443), tcp_flags=2, length=F.lit(60), scenario="beacon")


def exfiltration(spark: SparkSession, seed: int, start: int = 120, chunks: int = 4000, every: float = 0.2) -> DataFrame:
    """Steady uploads from one host to one server, hardly answered."""
    answer = F.col("id") % 50 == 49
    a, b = F.lit((10 << 24) | (20 << 16) | (2 << 8) | 18), F.lit((185 << 24) | (244 << 16) | (25 << 8) | 61)
    at = (F.lit(BASE_US + start * SECOND) + F.floor(F.col("id") * every * SECOND)).cast("long")
    return _packets(spark, chunks, ts_us=at, src_ip=F.when(answer, b).otherwise(a), dst_ip=F.when(answer, a).otherwise(b), src_port=F.when(answer, 443).otherwise(49_152), dst_port=F.when(answer, 49_152).otherwise(443), length=F.when(answer, 60).otherwise(1400), scenario="exfiltration")


def names(spark: SparkSession, seed: int, n: int = 550, start: int = 120, seconds: int = 300) -> DataFrame:
    """DNS queries for random names from one host, nearly all unknown: src_ip, ts_us, is_response, rcode, answers, qtype,
    qname."""
    label = F.concat_ws("", *[F.substr(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), (_pick(seed, 10 + k, 36) + 1).cast("int"), F.lit(1)) for k in range(14)])
    q = spark.range(n).select("id", _at(seed, start, seconds).alias("ts_us"), F.concat(label, F.lit(".net")).alias("qname"))
    both = q.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_response"))
    return both.select(F.lit((10 << 24) | (20 << 16) | (3 << 8) | 31).alias("src_ip"), (F.col("ts_us") + F.when(F.col("is_response"), 2000).otherwise(0)).alias("ts_us"), "is_response", F.when(_unit(seed, 3) < 0.97, 3).otherwise(0).alias("rcode"), F.lit(0).alias("answers"), F.lit(1).alias("qtype"), "qname")


def udp_reflection(spark: SparkSession, seed: int, start: int = 60, seconds: int = 45, requests: int = 1575) -> DataFrame:
    """Requests in the victim's name to 48 reflectors, two large replies each."""
    reflector = F.lit((198 << 24) | (51 << 16)) + _pick(seed, 2, 48)
    victim = F.lit((10 << 24) | (20 << 16) | (4 << 8) | 25)
    out = F.col("id") % 15 == 14  # most requests never pass here: they were sent from elsewhere
    service = F.when(_unit(seed, 3) < 0.5, 53).otherwise(123)
    return _packets(spark, requests * 2, proto=17, ts_us=_at(seed, start, seconds), src_ip=F.when(out, victim).otherwise(reflector), dst_ip=F.when(out, reflector).otherwise(victim), src_port=F.when(out, 40_000).otherwise(service), dst_port=F.when(out, service).otherwise(40_000), length=F.when(out, 60).otherwise(420 + _pick(seed, 5, 120)), tcp_flags=0, scenario="udp_reflection")


def slowloris(spark: SparkSession, seed: int, start: int = 90, connections: int = 400, sources: int = 14) -> DataFrame:
    """Half-open connections from few sources, small drips, no teardown."""
    src = F.lit((172 << 24) | (16 << 16)) + F.col("id") % sources
    port = (1024 + F.floor(F.col("id") / 8) * 37 % 60_000).cast("int")
    n = connections * 8
    first = F.col("id") % 8 == 0
    at = (F.lit(BASE_US + start * SECOND) + F.floor((F.col("id") % 8) * 8.0 * SECOND + F.floor(F.col("id") / 8) * 100_000)).cast("long")
    return _packets(spark, n, ts_us=at, src_ip=src, dst_ip=F.lit((10 << 24) | (20 << 16) | (4 << 8) | 26), src_port=port, dst_port=80, tcp_flags=F.when(first, 2).otherwise(24), length=F.when(first, 44).otherwise(90), scenario="slowloris")


def tunnel(spark: SparkSession, seed: int, n: int = 2200, start: int = 60, seconds: int = 480, zone: str = "relay-example.net") -> DataFrame:
    """DNS queries of one host with long random labels below one zone, mostly TXT; columns as of ``names`` and domain."""
    label = F.concat_ws("", *[F.substr(F.lit("abcdefghijklmnopqrstuvwxyz234567"), (_pick(seed, 30 + k, 32) + 1).cast("int"), F.lit(1)) for k in range(44)])
    q = spark.range(n).select(F.lit((10 << 24) | (20 << 16) | (3 << 8) | 32).alias("src_ip"), _at(seed, start, seconds).alias("ts_us"), F.lit(False).alias("is_response"), F.lit(0).alias("rcode"), F.lit(0).alias("answers"), F.when(_unit(seed, 3) < 0.7, 16).otherwise(10).alias("qtype"), F.concat(label, F.lit(f".{zone}")).alias("qname"))
    return q.withColumn("domain", F.lit(zone))


def exfil_bulk(spark: SparkSession, seed: int, start: int = 120, stages: int = 30, chunks: int = 60, burst: int = 3700) -> DataFrame:
    """Uploads from one host to one server in stages a minute apart, one of them far larger; hardly answered."""
    n = stages * chunks + burst
    big = F.col("id") >= stages * chunks
    second = F.when(big, F.lit(400.0) + F.col("id") / 500.0 % 20).otherwise(F.floor(F.col("id") / chunks) * 60.0 + F.col("id") % chunks / 10.0)
    answer = F.col("id") % 60 == 59
    a, b = F.lit((10 << 24) | (20 << 16) | (2 << 8) | 19), F.lit((91 << 24) | (219 << 16) | (238 << 8) | 44)
    at = (F.lit(BASE_US + start * SECOND) + F.floor(second * SECOND) + F.col("id")).cast("long")
    return _packets(spark, n, ts_us=at, src_ip=F.when(answer, b).otherwise(a), dst_ip=F.when(answer, a).otherwise(b), src_port=F.when(answer, 443).otherwise(49_200), dst_port=F.when(answer, 49_200).otherwise(443), length=F.when(answer, 60).otherwise(1440), scenario="exfil_bulk")


def tls_sessions(spark: SparkSession, seed: int, client: tuple[str, str], host: int, sessions: int, start: int = 30, every: float = 41.0, scenario: str = "benign") -> DataFrame:
    """Sessions of one host: a SYN with its TCP fingerprint, then a client hello; to a server of its own each time."""
    hello = F.col("id") % 2 == 1
    k = F.floor(F.col("id") / 2)
    at = (F.lit(BASE_US + start * SECOND) + F.floor(k * every * SECOND) + F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(20 * SECOND)) + F.col("id") % 2 * 30_000).cast("long")
    p = _packets(spark, 2 * sessions, ts_us=at, src_ip=F.lit(host).cast("long"), dst_ip=(F.lit((93 << 24) | (184 << 16) | (9 << 8)) + k % 200).cast("long"), src_port=(51_000 + k).cast("int"), dst_port=443, tcp_flags=F.when(hello, 24).otherwise(2), length=F.when(hello, 560).otherwise(60), scenario=scenario)
    return p.withColumns({"ja4": F.when(hello, client[0]), "tcp_print": F.when(~hello, client[1]).otherwise("")})


def ja4_spoof(spark: SparkSession, seed: int) -> DataFrame:
    """Three hosts whose TLS client says one system and whose TCP stack another."""
    hosts = [tls_sessions(spark, seed, (CHROME_WINDOWS[0], FIREFOX_LINUX[1]), (10 << 24) | (20 << 16) | (3 << 8) | (60 + k), 14, 40 + 7 * k, 37.0, "ja4_spoof") for k in range(3)]
    return hosts[0].unionByName(hosts[1]).unionByName(hosts[2])


def as_dns_packets(queries: DataFrame, scenario: str) -> DataFrame:
    """Rows of ``names`` or ``tunnel`` as packets to and from the resolver."""
    asks = ~F.col("is_response")
    return queries.select(
        F.pmod(F.xxhash64("qname", "is_response", "ts_us"), F.lit(1 << 40)).alias("id"), "ts_us", F.lit(17).alias("proto"), F.when(asks, F.col("src_ip")).otherwise(F.lit(RESOLVER)).cast("long").alias("src_ip"), F.when(asks, F.lit(RESOLVER)).otherwise(F.col("src_ip")).cast("long").alias("dst_ip"),
        F.when(asks, F.pmod(F.xxhash64("qname"), F.lit(20_000)) + 40_000).otherwise(53).cast("int").alias("src_port"), F.when(asks, 53).otherwise(F.pmod(F.xxhash64("qname"), F.lit(20_000)) + 40_000).cast("int").alias("dst_port"),
        F.lit(80).alias("length"), F.lit(0).alias("tcp_flags"), F.lit(1).alias("packets"), F.lit(scenario).alias("scenario"), "qname", "qtype", F.col("is_response").alias("dns_response"), F.col("rcode").alias("dns_rcode"), F.col("answers").alias("dns_answers"),
    )


def _answered(queries: DataFrame) -> DataFrame:
    answers = queries.withColumns({"is_response": F.lit(True), "ts_us": F.col("ts_us") + 2000, "answers": F.lit(1)})
    return queries.unionByName(answers)


def whole(packets: DataFrame) -> DataFrame:
    """packets with every column that the engine reads, and ``event_id`` made of scenario and id."""
    missing = {"qname": "string", "qtype": "int", "dns_response": "boolean", "dns_rcode": "int", "dns_answers": "int", "ja4": "string", "tcp_print": "string"}
    p = packets.withColumns({k: F.lit(None).cast(v) for k, v in missing.items() if k not in packets.columns})
    kinds = {"proto": "int", "src_ip": "long", "dst_ip": "long", "src_port": "int", "dst_port": "int", "length": "long", "tcp_flags": "int", "packets": "int", "ts_us": "long"}
    return p.select(F.xxhash64("scenario", "id", "src_ip", "ts_us").alias("event_id"), "scenario", *[F.col(k).cast(v).alias(k) for k, v in kinds.items()], F.coalesce("tcp_print", F.lit("")).alias("tcp_print"), *[k for k in missing if k != "tcp_print"])


def benign(spark: SparkSession, seed: int, seconds: int = 300) -> DataFrame:
    """Background with TLS sessions of two kinds of hosts and ordinary name look-ups."""
    words = F.array(*map(F.lit, ORDINARY))
    pick = lambda salt: F.element_at(words, (_pick(seed, salt, len(ORDINARY)) + 1).cast("int"))
    q = spark.range(seconds // 2).select("id", _at(seed + 1, 0, seconds).alias("ts_us"), (F.lit((10 << 24) | (20 << 16) | (1 << 8) | 10) + _pick(seed, 81, 40)).alias("src_ip"), F.concat(F.lit("www."), pick(82), F.lit(".org")).alias("qname"))
    q = q.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_response"), F.lit(0).alias("rcode"), F.lit(1).alias("answers"), F.lit(1).alias("qtype")).drop("id")
    q = q.withColumn("ts_us", F.col("ts_us") + F.when(F.col("is_response"), 2000).otherwise(0))
    parts = [background(spark, seed, seconds), as_dns_packets(q, "benign")]
    parts += [tls_sessions(spark, seed + k, (CHROME_WINDOWS, FIREFOX_LINUX)[k % 2], (10 << 24) | (20 << 16) | (3 << 8) | (80 + k), max(2, seconds // 60), 20 + k, 29.0) for k in range(4)]
    return _union([whole(x) for x in parts])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


#: Words of ordinary names; the bigram model of tests and benchmarks is made of them.
ORDINARY = ("network", "service", "weather", "library", "mountain", "research", "science", "garden", "history", "journal", "market", "planet", "school", "travel", "theatre", "village", "station", "support", "updates", "archive", "classic", "concert", "digital", "example", "football", "general", "holiday", "internet", "kitchen", "language")

ATTACKS = {
    "syn_flood": lambda s, k: syn_flood(s, k),
    "udp_reflection": lambda s, k: udp_reflection(s, k, start=1000),
    "slowloris": lambda s, k: slowloris(s, k),
    "beacon": lambda s, k: beacon(s, k, jitter=0.1),
    "dga": lambda s, k: as_dns_packets(names(s, k), "dga"),
    "tunnel": lambda s, k: as_dns_packets(_answered(tunnel(s, k)), "tunnel"),
    "ja4_spoof": lambda s, k: ja4_spoof(s, k),
    "port_scan": lambda s, k: port_scan(s, k),
    "exfil_drip": lambda s, k: exfiltration(s, k),
    "exfil_bulk": lambda s, k: exfil_bulk(s, k),
}


def corpus(spark: SparkSession, seed: int, seconds: int = 2900) -> DataFrame:
    """Background and every attack, each on hosts of its own: about 105,000 packets."""
    return _union([benign(spark, seed, seconds), *[whole(make(spark, seed)) for make in ATTACKS.values()]])
