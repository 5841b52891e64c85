"""Detectors over the event table seen as packets; windows and thresholds fit its sparse traffic."""

from pyspark.sql import functions as F

from flowmill.operators import detectors, engine, flows
from flowmill.plans.registry import query
from flowmill.sources.packets import EVENTS_AS_PACKETS_SQL, events_as_packets

P = f"p AS ({EVENTS_AS_PACKETS_SQL})"
HOUR, DAY = 3_600_000_000, 86_400_000_000


def _p(t):
    return events_as_packets(t.events)


def rounded(df, places=4):
    return df.withColumns({c: F.round(F.col(c) + 0.0, places) for c, kind in df.dtypes if kind == "double"})


def fixed(sql_columns, places=4):
    return ", ".join(f"round({x}, {places}) AS {n}" for x, n in sql_columns)


BURST = f"""WITH RECURSIVE {P}, c AS (SELECT dst_ip, ts_us // {DAY} AS bucket, src_ip, count(*) AS n FROM p GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY dst_ip, bucket) AS total FROM c),
f AS (SELECT dst_ip, bucket, count(*) AS sources, CAST(any_value(total) AS BIGINT) AS total, CASE WHEN count(*) > 1 THEN -sum(n / total * ln(n / total)) / ln(count(*)) ELSE 0 END AS entropy, (bucket + 1) * {DAY} AS ts_us FROM w GROUP BY dst_ip, bucket),
g AS (SELECT * FROM f WHERE total >= LEAST_N AND entropy >= 0.7), r AS (SELECT dst_ip, min(ts_us) AS ts_us FROM g GROUP BY 1 UNION ALL
SELECT dst_ip, ts_us FROM (SELECT g.dst_ip, min(g.ts_us) AS ts_us FROM r JOIN g ON g.dst_ip = r.dst_ip AND g.ts_us >= r.ts_us + {2 * DAY} GROUP BY g.dst_ip, r.ts_us))
SELECT dst_ip, ts_us, bucket, sources, total, round(entropy, 4) AS entropy, round(conf, 4) AS confidence, CASE WHEN conf < 0.6 THEN 'LOW' WHEN conf < 0.75 THEN 'MEDIUM' WHEN conf < 0.9 THEN 'HIGH' ELSE 'CRITICAL' END AS severity
FROM (SELECT *, round(least(0.99, 0.55 + 0.04 * least(10.0, total / LEAST_N) + 0.2 * entropy), 4) AS conf FROM r JOIN g USING (dst_ip, ts_us))"""


@query(BURST.replace("LEAST_N", "5"))
def fallback_burst(t):
    return rounded(detectors.burst_rule(_p(t), "dst_ip", "src_ip", DAY, least=5, gap_us=2 * DAY))


def two(value, over="w"):
    """SQL of the larger of a window's value and that of the window just before; ``b`` is the window's number."""
    return f"greatest({value}, CASE WHEN b - lag(b) OVER {over} = 1 THEN lag({value}) OVER {over} ELSE 0 END)"


DDOS = f"""{P}, s AS (SELECT dst_ip AS host, ts_us // {DAY} AS bucket, src_ip, count(*) AS n, sum(length) AS bytes, sum(CASE WHEN proto = 6 AND (tcp_flags & 18) = 2 THEN 1 ELSE 0 END) AS syn,
 sum(CASE WHEN proto = 17 THEN 1 ELSE 0 END) AS udp, sum(CASE WHEN proto = 17 AND src_port IN (17, 19, 53, 123, 161, 389, 1900, 3283, 3389, 3702, 5353, 11211) THEN 1 ELSE 0 END) AS service FROM p GROUP BY ALL),
a AS (SELECT host, bucket, sum(n) AS n, sum(bytes) AS bytes, sum(syn) AS syn, sum(udp) AS udp, sum(service) AS service, count(*) AS sources, sum(n * ln(n)) AS ln FROM s GROUP BY ALL),
b AS (SELECT src_ip AS host, ts_us // {DAY} AS bucket, sum(CASE WHEN proto = 6 AND (tcp_flags & 18) = 18 THEN 1 ELSE 0 END) AS syn_ack FROM p GROUP BY ALL),
e AS (SELECT dst_ip AS host, true AS inward, * FROM p UNION ALL SELECT src_ip AS host, false AS inward, * FROM p),
l0 AS (SELECT host, ts_us // {7 * DAY} AS b, count(*) FILTER (inward AND proto = 6 AND (tcp_flags & 18) = 2) AS syn60, count(*) FILTER (inward AND proto = 6 AND (tcp_flags & 1) = 1) AS fin60, count(*) FILTER (inward AND proto = 6 AND (tcp_flags & 4) = 4) AS rst60,
 sum(CASE WHEN inward THEN length ELSE 0 END) AS bytes_in60, sum(CASE WHEN inward THEN 0 ELSE length END) AS bytes_out60, sum(CASE WHEN inward AND proto = 17 THEN length ELSE 0 END) AS udp_in, sum(CASE WHEN proto = 17 AND NOT inward THEN length ELSE 0 END) AS udp_out,
 count(DISTINCT CASE WHEN inward THEN src_ip END) AS s0, count(DISTINCT CASE WHEN inward THEN src_ip * 100000 + src_port END) AS p0 FROM e GROUP BY ALL),
l AS (SELECT *, b AS long, {two("s0")} AS sources60, {two("p0")} AS ports60 FROM l0 WINDOW w AS (PARTITION BY host ORDER BY b)),
j AS (SELECT a.*, coalesce(syn_ack, 0) AS syn_ack, syn60, fin60, rst60, udp_in, udp_out, sources60, ports60, bytes_in60, bytes_out60, CASE WHEN sources >= 2 THEN (ln(n) - a.ln / n) / ln(sources) ELSE 0 END AS h
 FROM a LEFT JOIN b USING (host, bucket) JOIN l ON l.host = a.host AND l.long = a.bucket // 7)"""


@query(
    f"""WITH {DDOS} SELECT host, bucket, round(n * 1e6 / {DAY}, 8) AS pps, {fixed([("bytes / n", "mean_bytes")])}, sources, sources60, ports60, {fixed([("h", "src_entropy"), ("CASE WHEN sources >= 2 AND least(n, 512) > 1 THEN h * log2(sources) / log2(least(n, 512)) ELSE 0 END", "src_entropy_ratio"),
 ("sources60 / greatest(1, sources)", "growth"), ("syn / greatest(1, syn_ack)", "syn_synack_ratio"), ("udp / greatest(1, n)", "udp_share"), ("service / greatest(1, udp)", "service_share"), ("udp_in / greatest(1, udp_out)", "amplification")])},
 udp_out > 0 AS udp_egress, CAST(greatest(0, syn60 - fin60 - rst60) AS BIGINT) AS half_open, round((fin60 + rst60) / greatest(1, syn60), 4) AS teardown, CAST(bytes_in60 AS BIGINT) AS bytes_in60, CAST(bytes_out60 AS BIGINT) AS bytes_out60 FROM j"""
)
def ddos_bucket_features(t):
    f = detectors.ddos_features(_p(t), DAY, 7 * DAY)
    pps = F.round("pps", 8)
    return rounded(f.withColumn("pps", pps.cast("decimal(18,8)"))).withColumn("pps", F.col("pps").cast("double"))


PRIOR = f"""{DDOS}, pp AS (SELECT bucket // 7 AS m, CAST(count(*) AS DOUBLE) AS n, sum(least(n, 25.0)) AS s, sum(pow(least(n, 25.0), 2)) AS q FROM j GROUP BY 1),
pr AS (SELECT m + k AS m, sum(n * pow(0.5, k / 10.0)) AS n, sum(s * pow(0.5, k / 10.0)) AS s, sum(q * pow(0.5, k / 10.0)) AS q FROM pp, range(1, 61) r(k) GROUP BY ALL),
prior AS (SELECT pp.m, coalesce(pr.s, pp.s) / coalesce(pr.n, pp.n) AS pm, greatest(0, coalesce(pr.q, pp.q) / coalesce(pr.n, pp.n) - pow(coalesce(pr.s, pp.s) / coalesce(pr.n, pp.n), 2)) AS pv FROM pp LEFT JOIN pr USING (m)),
o AS (SELECT j.*, CAST(n AS DOUBLE) AS x, pm, pv, row_number() OVER (PARTITION BY host ORDER BY bucket) AS i FROM j JOIN prior ON m = bucket // 7),
r AS (SELECT host, bucket, i, (x - pm) / sqrt(greatest(pv, pm, 1)) AS dev, CASE WHEN (x - pm) / sqrt(greatest(pv, pm, 1)) < 4 THEN x ELSE pm + 4 * sqrt(greatest(pv, pm, 1)) END AS mean, CAST(0 AS DOUBLE) AS var FROM o WHERE i = 1
 UNION ALL SELECT host, bucket, i, dev, mean + 0.1 * (seen - mean), 0.9 * (var + 0.1 * pow(seen - mean, 2)) FROM (SELECT *, CASE WHEN dev < 4 THEN x ELSE bm + 4 * sd END AS seen FROM (SELECT *, (x - bm) / sd AS dev FROM (
 SELECT o.host, o.bucket, o.i, o.x, r.mean, r.var, CASE WHEN r.i >= 5 THEN r.mean ELSE o.pm END AS bm, sqrt(greatest(CASE WHEN r.i >= 5 THEN r.var ELSE o.pv END, CASE WHEN r.i >= 5 THEN r.mean ELSE o.pm END, 1)) AS sd FROM r JOIN o ON o.host = r.host AND o.i = r.i + 1))))"""


@query(f"WITH RECURSIVE {PRIOR} SELECT host, bucket, round(dev, 4) AS deviation, CASE WHEN i > 5 THEN 'destination' ELSE 'population' END AS basis FROM r")
def population_baseline(t):
    f = detectors.ddos_features(_p(t), DAY, 7 * DAY).withColumn("pps", F.col("pps") * 86_400)
    return rounded(detectors.with_prior(f, ["host"], "bucket", "pps", 7)).select("host", "bucket", "deviation", "basis")


def spaced_sql(hits, key, gap):
    """SQL of the rows of ``hits`` that a cooldown lets through, as ``k``."""
    same = " AND ".join(f"h.{c} = k.{c}" for c in key)
    cols, own = ", ".join(key), ", ".join(f"h.{c}" for c in key)
    return f"k AS (SELECT {cols}, min(bucket) AS bucket FROM {hits} GROUP BY {cols} UNION ALL SELECT {cols}, bucket FROM (SELECT {own}, min(h.bucket) AS bucket FROM k JOIN {hits} h ON {same} AND h.bucket >= k.bucket + {gap} GROUP BY {own}, k.bucket))"


@query(f"""WITH RECURSIVE {PRIOR}, hits AS (SELECT * FROM (SELECT o.host, o.bucket, dev, CASE WHEN x < 1 AND greatest(0, syn60 - fin60 - rst60) < 3 THEN NULL WHEN dev > 1 AND syn / greatest(1, syn_ack) > 0.2 THEN 'syn-flood-spoofed-source'
 WHEN dev > 1 AND udp / n >= 0.1 AND udp_in / greatest(1, udp_out) > 0.1 THEN 'udp-flood-suspected-spoofed-source'
 WHEN greatest(0, syn60 - fin60 - rst60) >= 3 AND (fin60 + rst60) / greatest(1, syn60) <= 0.1 AND x <= 60 AND sources60 >= 4 AND bytes / n > 0 AND bytes / n <= 200 THEN 'connection-exhaustion' END AS subtype FROM o JOIN r USING (host, bucket)) WHERE subtype IS NOT NULL),
{spaced_sql("hits", ["host"], 2)} SELECT host, bucket, round(dev, 4) AS deviation, subtype FROM k JOIN hits USING (host, bucket)""")
def ddos_rule(t):
    f = detectors.ddos_features(_p(t), DAY, 7 * DAY).withColumn("pps", F.col("pps") * 86_400)
    f = detectors.with_prior(f, ["host"], "bucket", "pps", 7)
    d = detectors.ddos_rule(f, sigma=1.0, explosion=0.0, collapse=0.0, syn_ratio=0.2, amplification=0.1, floor=1.0, half_open=3.0, udp=0.1, gap=2)
    return rounded(d).select("host", "bucket", "deviation", "subtype")


FLOODS = f"f AS (SELECT proto, dst_ip, ts_us // {DAY} AS bucket, count(*) AS n, count(*) FILTER (proto = 6 AND (tcp_flags & 18) = 2) AS syns FROM p GROUP BY ALL)"


@query(f"WITH RECURSIVE {P}, {FLOODS}, hits AS (SELECT * FROM f WHERE n >= 30), {spaced_sql('hits', ['proto', 'dst_ip'], 2)} SELECT proto, dst_ip, bucket, n FROM k JOIN hits USING (proto, dst_ip, bucket)")
def flood_absolute(t):
    return detectors.flood_rule(_p(t), DAY, absolute=30, floor=0, gap=2).select("proto", "dst_ip", "bucket", "n")


@query(f"WITH {P}, {FLOODS} SELECT dst_ip, bucket, syns, CASE WHEN n >= 40 THEN 'tcp-rate-anomaly' ELSE 'tcp-syn-rate-anomaly' END AS subtype FROM f WHERE proto = 6 AND (n >= 40 OR syns >= 4)")
def flood_syn(t):
    return detectors.flood_rule(_p(t).filter("proto = 6"), DAY, absolute=40, floor=0, syn_absolute=4, gap=1).select("dst_ip", "bucket", "syns", "subtype")


FOLD = f"""{FLOODS}, o AS (SELECT *, row_number() OVER (PARTITION BY proto, dst_ip ORDER BY bucket) AS i FROM f), r AS (
SELECT proto, dst_ip, bucket, i, n, CAST(n AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS var, CAST(n AS DOUBLE) AS dev FROM o WHERE i = 1
UNION ALL SELECT proto, dst_ip, bucket, i, n, mean + 0.1 * (seen - mean), 0.9 * (var + 0.1 * pow(seen - mean, 2)), dev FROM (SELECT o.proto, o.dst_ip, o.bucket, o.i, o.n, r.mean, r.var, (o.n - r.mean) / sqrt(greatest(1, r.mean, r.var)) AS dev,
 CASE WHEN r.i < 10 THEN o.n ELSE least(o.n, r.mean + 3 * sqrt(greatest(1, r.mean, r.var))) END AS seen FROM r JOIN o ON o.proto = r.proto AND o.dst_ip = r.dst_ip AND o.i = r.i + 1))"""


@query(f"WITH RECURSIVE {P}, {FOLD} SELECT proto, dst_ip, bucket, n, round(dev, 4) AS deviation, CASE proto WHEN 17 THEN 'udp-rate-anomaly' ELSE 'tcp-rate-anomaly' END AS subtype FROM r WHERE i > 10 AND n >= 5 AND dev >= 1.5")
def flood_baseline(t):
    d = detectors.flood_rule(_p(t), DAY, absolute=0, floor=5, sigmas=1.5, gap=1)
    return rounded(d).select("proto", "dst_ip", "bucket", "n", "deviation", "subtype")


@query(f"""WITH RECURSIVE {P}, h AS (SELECT ts_us // {DAY} AS b, src_ip, count(*) AS n FROM p GROUP BY ALL), even AS (SELECT b, CASE WHEN count(*) > 1 THEN (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) ELSE 0 END AS e FROM h GROUP BY 1),
s AS (SELECT dst_ip AS subject, ts_us // {DAY} AS b, count(*) FILTER ((tcp_flags & 18) = 2) AS syn, count(*) FILTER ((tcp_flags & 18) = 18) AS ack FROM p WHERE proto = 6 GROUP BY ALL),
w AS (SELECT src_ip, ts_us // {7 * DAY} AS b, dst_port, count(DISTINCT dst_ip) AS h FROM p WHERE proto = 6 AND (tcp_flags & 18) = 2 GROUP BY ALL), v AS (SELECT src_ip AS subject, b, count(*) AS v, max(h) AS h FROM w GROUP BY ALL),
x AS (SELECT subject, (b + 1) * {DAY} AS bucket, 'volumetric-ddos' AS threat_class, 'syn-flood' AS subtype, round(least(0.99, 0.55 + 0.04 * least(10.0, syn / greatest(1, ack)) + 0.2 * e), 4) AS confidence FROM s JOIN even USING (b) WHERE syn >= 2 AND syn / greatest(1, ack) >= 0.5 AND e >= 0.7
 UNION ALL SELECT subject, (b + 1) * {7 * DAY}, 'recon-scanning', CASE WHEN v >= h THEN 'vertical-scan' ELSE 'horizontal-scan' END, round(least(0.97, 0.6 + greatest(v, h) / 1000.0), 4) FROM v WHERE greatest(v, h) >= 3),
{spaced_sql("x", ["threat_class", "subject"], 2 * DAY)} SELECT threat_class, subject, bucket AS ts_us, subtype, confidence, CASE WHEN threat_class = 'recon-scanning' THEN 'MEDIUM' WHEN confidence < 0.9 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM k JOIN x USING (threat_class, subject, bucket)""")
def fallback_rules(t):
    return rounded(detectors.fallback_rules(_p(t), DAY, 7 * DAY, least=2, ratio=0.5, fanout=3, gap_us=2 * DAY))


SIDES = " UNION ALL ".join([f"SELECT src_ip, {k} AS scale, '{kind}' AS kind, ts_us // {w * DAY} AS b, {key} AS key, {value} AS value FROM q" for k, w in enumerate((1, 7, 28)) for kind, key, value in (("v", "dst_ip", "dst_port"), ("h", "dst_port", "dst_ip"))] + [f"SELECT src_ip, 2, '{kind}', ts_us // {28 * DAY}, NULL, {value} FROM q" for kind, value in (("ports", "dst_port"), ("hosts", "dst_ip"))])
SCAN = f"""{P}, q AS (SELECT * FROM p WHERE proto = 6 AND (tcp_flags & 18) = 2), x AS ({SIDES}),
n0 AS (SELECT src_ip, scale, kind, key, b, count(DISTINCT value) AS n FROM x GROUP BY ALL), n1 AS (SELECT *, {two("n")} AS m FROM n0 WINDOW w AS (PARTITION BY src_ip, scale, kind, key ORDER BY b)),
narrow AS (SELECT src_ip, CASE scale WHEN 0 THEN b // 7 ELSE b END AS bucket, max(m) FILTER (scale = 0 AND kind = 'v') AS vertical_1, max(m) FILTER (scale = 0 AND kind = 'h') AS horizontal_1, max(m) FILTER (scale = 1 AND kind = 'v') AS vertical_60, max(m) FILTER (scale = 1 AND kind = 'h') AS horizontal_60 FROM n1 WHERE scale < 2 GROUP BY ALL),
wide AS (SELECT src_ip, b AS long, max(m) FILTER (kind = 'v') AS vertical_3600, max(m) FILTER (kind = 'h') AS horizontal_3600, max(m) FILTER (kind = 'ports') AS ports, max(m) FILTER (kind = 'hosts') AS hosts FROM n1 WHERE scale = 2 GROUP BY ALL),
a AS (SELECT src_ip, ts_us // {7 * DAY} AS bucket, count(*) AS probes, CAST(sum(length) AS BIGINT) AS bytes FROM q GROUP BY ALL),
c AS (SELECT dst_ip AS src_ip, ts_us // {7 * DAY} AS bucket, count(*) FILTER ((tcp_flags & 18) = 18) AS syn_ack, count(*) FILTER ((tcp_flags & 6) = 4) AS rst FROM p WHERE proto = 6 GROUP BY ALL),
f AS (SELECT a.*, vertical_1, horizontal_1, vertical_60, horizontal_60, vertical_3600, horizontal_3600, ports, hosts, coalesce(syn_ack, 0) AS syn_ack, coalesce(rst, 0) AS rst, CASE WHEN ports BETWEEN 2 AND 20 THEN greatest(0, least(1, (hosts - 30) / 30)) ELSE 0.0 END AS strobe FROM a JOIN narrow USING (src_ip, bucket) JOIN wide ON wide.src_ip = a.src_ip AND long = a.bucket // 4 LEFT JOIN c ON c.src_ip = a.src_ip AND c.bucket = a.bucket)"""


def _scan(t):
    return detectors.scan_features(_p(t), (DAY, 7 * DAY, 28 * DAY))


@query(f"WITH {SCAN} SELECT *, round(syn_ack / greatest(1, probes), 4) AS completion, round(rst / greatest(1, probes), 4) AS rst_ratio, round(bytes / probes, 4) AS bytes_per_probe FROM f")
def scan_features(t):
    return rounded(_scan(t))


@query(f"""WITH {SCAN}, g AS (SELECT *, greatest(vertical_60, vertical_3600) AS v, greatest(horizontal_60, horizontal_3600) AS h FROM f)
SELECT src_ip, bucket, CASE WHEN v >= 3 AND v >= h AND vertical_1 >= 2 THEN 'vertical-scan-fast' WHEN v >= 3 AND v >= h THEN 'vertical-scan-slow' WHEN strobe > 0 AND ports > 1 THEN 'strobe-scan' ELSE 'horizontal-sweep' END AS subtype
FROM g WHERE probes >= 2 AND bytes / probes <= 1000 AND (v >= 3 AND v >= h OR h >= 2)""")
def scan_rules(t):
    return detectors.scan_rule(_scan(t), ports=3, hosts=2, least=2, bytes_per_probe=1000, completion=10**6, fast=2).select("src_ip", "bucket", "subtype")


FLOW = f"""{P}, k AS (SELECT *, src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) AS fwd FROM p),
l AS (SELECT *, CASE WHEN fwd THEN src_ip ELSE dst_ip END AS lo_ip, CASE WHEN fwd THEN src_port ELSE dst_port END AS lo_port, CASE WHEN fwd THEN dst_ip ELSE src_ip END AS hi_ip, CASE WHEN fwd THEN dst_port ELSE src_port END AS hi_port FROM k),
o AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY proto, lo_ip, lo_port, hi_ip, hi_port ORDER BY ts_us, event_id) >= {3 * DAY} THEN 1 ELSE 0 END AS brk FROM l),
s AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY proto, lo_ip, lo_port, hi_ip, hi_port ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM o),
f AS (SELECT proto, lo_ip, lo_port, hi_ip, hi_port, session, min(ts_us) AS first_us, round((max(ts_us) - min(ts_us)) / 1e6, 6) AS duration, sum(CASE WHEN fwd THEN 1 ELSE 0 END) AS n_lo, sum(CASE WHEN fwd THEN 0 ELSE 1 END) AS n_hi, sum(CASE WHEN fwd THEN length ELSE 0 END) AS b_lo, sum(CASE WHEN fwd THEN 0 ELSE length END) AS b_hi,
 bit_or(CASE WHEN proto = 6 THEN tcp_flags ELSE 0 END) AS flags_seen_bitmap, bool_or(proto = 6 AND (tcp_flags & 18) = 2) AS saw_syn, bool_or(proto = 6 AND (tcp_flags & 18) = 18) AS saw_syn_ack, bool_or(proto = 6 AND (tcp_flags & 1) = 1) AS saw_fin, bool_or(proto = 6 AND (tcp_flags & 4) = 4) AS saw_rst,
 arg_max(fwd, (ts_us - 1704067200000000) * 100000 + event_id) FILTER (proto = 6 AND (tcp_flags & 18) = 2) AS syn, arg_max(NOT fwd, (ts_us - 1704067200000000) * 100000 + event_id) FILTER (proto = 6 AND (tcp_flags & 18) = 18) AS sa,
 arg_min(src_port, (ts_us - 1704067200000000) * 100000 + event_id) AS sp, arg_min(dst_port, (ts_us - 1704067200000000) * 100000 + event_id) AS dp, arg_min(fwd, (ts_us - 1704067200000000) * 100000 + event_id) AS ff FROM s GROUP BY ALL),
g AS (SELECT *, (sp > 0 AND sp < 1024 OR sp IN (1080, 1194, 1433, 1521, 3128, 3306, 3389, 5432, 5900, 6379, 8000, 8080, 8443, 9200, 27017)) AS ss, (dp > 0 AND dp < 1024 OR dp IN (1080, 1194, 1433, 1521, 3128, 3306, 3389, 5432, 5900, 6379, 8000, 8080, 8443, 9200, 27017)) AS ds FROM f),
i AS (SELECT *, coalesce(syn, sa, CASE WHEN (CASE WHEN ss <> ds THEN NOT ss WHEN sp <> dp THEN sp > dp ELSE true END) THEN ff ELSE NOT ff END) AS initiator_is_lo, CAST(CASE WHEN syn IS NOT NULL OR sa IS NOT NULL THEN 1.0 WHEN ss <> ds THEN 0.75 ELSE 0.5 END AS DOUBLE) AS orientation_confidence FROM g)"""
ORIENTED = f"""{FLOW}, z AS (SELECT s.event_id, s.ts_us, s.length, s.proto, s.fwd = i.initiator_is_lo AS outward, CASE WHEN s.fwd = i.initiator_is_lo THEN src_ip ELSE dst_ip END AS client, CASE WHEN s.fwd = i.initiator_is_lo THEN dst_ip ELSE src_ip END AS server, CASE WHEN s.fwd = i.initiator_is_lo THEN dst_port ELSE src_port END AS server_port,
 orientation_confidence, row_number() OVER (PARTITION BY proto, lo_ip, lo_port, hi_ip, hi_port, session ORDER BY s.ts_us, s.event_id) AS nth, s.tcp_flags FROM s JOIN i USING (proto, lo_ip, lo_port, hi_ip, hi_port, session))"""


def _oriented(t):
    return flows.oriented(_p(t), 3 * DAY)


@query(f"WITH {ORIENTED} SELECT event_id, client, server, server_port, outward, orientation_confidence, nth, (proto = 6 AND (tcp_flags & 18) = 2) OR (proto = 17 AND nth = 1) AS starts FROM z")
def oriented_packets(t):
    return _oriented(t).select("event_id", "client", "server", "server_port", "outward", "orientation_confidence", F.col("nth").cast("long").alias("nth"), flows.session_start().alias("starts"))


@query(f"WITH {ORIENTED} SELECT proto, client, server, server_port, count(*) FILTER (outward) AS pkts_fwd, count(*) FILTER (NOT outward) AS pkts_rev, CAST(sum(CASE WHEN outward THEN length ELSE 0 END) AS BIGINT) AS bytes_fwd, CAST(sum(CASE WHEN outward THEN 0 ELSE length END) AS BIGINT) AS bytes_rev, max(ts_us) AS last_us FROM z GROUP BY ALL")
def channel_table(t):
    return flows.channels(_oriented(t))


EXFIL = f"""{ORIENTED}, w AS (SELECT client, server, ts_us // {DAY} AS bucket, sum(CASE WHEN outward THEN length ELSE 0 END) AS "out", sum(CASE WHEN outward THEN 0 ELSE length END) AS "in" FROM z WHERE orientation_confidence >= 0.75 GROUP BY ALL),
x AS (SELECT *, "out" / greatest(1, "in") AS ratio, row_number() OVER (PARTITION BY client, server ORDER BY bucket) AS i FROM w),
y AS (SELECT a.client, a.server, a.bucket, sum(CASE WHEN b.i = 1 THEN pow(0.8, a.i - 1) * b.ratio ELSE 0.2 * pow(0.8, a.i - b.i) * b.ratio END) AS ratio_ewma, sum(b."out") AS out_total, sum(b."in") AS in_total, max(b."out") AS peak, sum(CASE WHEN b.ratio >= 3 THEN 86400.0 ELSE 0 END) AS sustained_s, (a.bucket - min(b.bucket)) * 86400.0 AS age_s
 FROM x a JOIN x b ON a.client = b.client AND a.server = b.server AND b.i <= a.i GROUP BY a.client, a.server, a.bucket),
d0 AS (SELECT server, ts_us // {7 * DAY} AS b, count(DISTINCT client) AS n FROM z WHERE orientation_confidence >= 0.75 GROUP BY ALL), d AS (SELECT *, {two("n")} AS fanout FROM d0 WINDOW w AS (PARTITION BY server ORDER BY b))"""


@query(f"""WITH {EXFIL} SELECT x.client, x.server, x.bucket, CAST(x."out" AS BIGINT) AS "out", CAST(x."in" AS BIGINT) AS "in", round(ratio, 4) AS ratio, CAST(out_total AS BIGINT) AS out_total, CAST(in_total AS BIGINT) AS in_total, CAST(peak AS BIGINT) AS peak, sustained_s, age_s, round(ratio_ewma, 4) AS ratio_ewma, fanout, round(greatest(0, least(1, 1 - ln(fanout) / ln(9))), 4) AS novelty
FROM x JOIN y USING (client, server, bucket) JOIN d ON d.server = x.server AND d.b = x.bucket // 7""")
def exfil_windows(t):
    return rounded(detectors.exfil_windows(_oriented(t), DAY, wide_us=7 * DAY)).drop("port", "proto", "surety")


@query(f"""WITH {EXFIL} SELECT client, server, bucket, CASE WHEN peak >= 80 THEN 'upload-burst' ELSE 'slow-drip-upload' END AS subtype, CASE WHEN server = 3 OR server BETWEEN 64 AND 127 THEN 'exfil-allowlist' END AS reason FROM y WHERE ratio_ewma >= 3 AND out_total >= 100 AND sustained_s >= 172800""")
def exfil_rule(t):
    known = t.spark.createDataFrame([("0.0.0.3/32", [], "one host", 1), ("0.0.0.64/26", [], "a network", 2)], "cidr string, ports array<int>, reason string, rank int")
    rows = detectors.exfil_windows(_oriented(t), DAY, wide_us=7 * DAY)
    return detectors.exfil_rule(rows, least_bytes=100, sustained_s=172_800, burst_bytes=80, gap=1, allowlist=known).select("client", "server", "bucket", "subtype", "reason")


@query(f"""WITH {EXFIL} SELECT 'exfil' AS detector, 'exfil-allowlist' AS reason, count(*) AS n FROM y WHERE ratio_ewma >= 3 AND out_total >= 100 AND sustained_s >= 172800 AND (server = 3 OR server BETWEEN 64 AND 127)""")
def suppression_counts(t):
    return engine.suppressed(exfil_rule(t).withColumn("detector", F.lit("exfil")))


QUERIES_SQL = f"""{P}, q AS (SELECT src_ip, ts_us, tcp_flags = 4 AS is_response, dst_port % 4 AS rcode, dst_port % 3 AS answers, CASE WHEN dst_port % 5 = 0 THEN 16 ELSE 1 END AS qtype, 'zone' || dst_ip AS domain, 'n' || dst_port || '.zone' || dst_ip AS qname, length / 100.0 AS score FROM p)"""


def _queries(t):
    k = F.col("dst_port")
    return _p(t).select(
        "src_ip",
        "ts_us",
        (F.col("tcp_flags") == 4).alias("is_response"),
        (k % 4).alias("rcode"),
        (k % 3).alias("answers"),
        F.when(k % 5 == 0, 16).otherwise(1).alias("qtype"),
        F.concat(F.lit("zone"), F.col("dst_ip").cast("string")).alias("domain"),
        F.concat(F.lit("n"), k.cast("string"), F.lit(".zone"), F.col("dst_ip").cast("string")).alias("qname"),
        (F.col("length") / 100.0).alias("score"),
    )


DGA = f"""{QUERIES_SQL}, f0 AS (SELECT src_ip, ts_us // {7 * DAY} AS b, count(*) FILTER (NOT is_response AND qtype IN (16, 10)) AS txt_null, sum(CASE WHEN NOT is_response THEN 1 ELSE 0 END) AS queries, sum(CASE WHEN is_response THEN 1 ELSE 0 END) AS responses, sum(CASE WHEN is_response AND rcode = 3 THEN 1 ELSE 0 END) AS nx,
 sum(CASE WHEN is_response AND rcode <> 3 AND answers = 0 THEN 1 ELSE 0 END) AS empty, count(DISTINCT CASE WHEN NOT is_response THEN domain END) AS d0, avg(CASE WHEN NOT is_response THEN score END) AS mean_score FROM q GROUP BY ALL),
f AS (SELECT *, b AS bucket, {two("d0")} AS domains FROM f0 WINDOW w AS (PARTITION BY src_ip ORDER BY b))"""


@query(f"WITH {DGA} SELECT src_ip, bucket, CAST(queries AS BIGINT) AS queries, CAST(responses AS BIGINT) AS responses, CAST(nx AS BIGINT) AS nx, CAST(empty AS BIGINT) AS empty, txt_null, domains, round(mean_score, 9) AS mean_score, round(nx / greatest(1, responses), 9) AS nx_ratio, round(empty / greatest(1, responses), 9) AS empty_ratio FROM f")
def dns_source_features(t):
    return rounded(detectors.dns_sources(_queries(t), 7 * DAY), 9)


@query(f"WITH {DGA} SELECT src_ip, bucket, CASE WHEN mean_score >= 0.3 THEN 'dga-high-entropy' ELSE 'dga-dictionary' END AS subtype FROM f WHERE domains >= 5 AND queries >= 8 AND (mean_score >= 0.3 OR nx / greatest(1, responses) >= 0.2)")
def dga_campaign(t):
    return detectors.dga_rule(detectors.dns_sources(_queries(t), 7 * DAY), domains=5, queries=8, score=0.3, nx=0.2).select("src_ip", "bucket", "subtype")


ZONES = f"""{QUERIES_SQL}, w0 AS (SELECT src_ip, domain, ts_us // {7 * DAY} AS b, count(*) AS queries, count(DISTINCT qname) AS n0, sum(CASE WHEN qtype IN (16, 10) THEN 1 ELSE 0 END) AS txt FROM q WHERE NOT is_response GROUP BY ALL), w AS (SELECT *, b AS bucket, {two("n0")} AS names, txt / greatest(1, queries) AS txt_ratio FROM w0 WINDOW w AS (PARTITION BY src_ip, domain ORDER BY b)),
x AS (SELECT *, row_number() OVER (PARTITION BY src_ip, domain ORDER BY bucket) AS i FROM w),
y AS (SELECT a.src_ip, a.domain, a.bucket, sum(CASE WHEN b.i = 1 THEN pow(0.95, a.i - 2) * b.names ELSE 0.05 * pow(0.95, a.i - 1 - b.i) * b.names END) AS baseline, sum(CASE WHEN b.i = 1 THEN pow(0.95, a.i - 2) * b.txt_ratio ELSE 0.05 * pow(0.95, a.i - 1 - b.i) * b.txt_ratio END) AS txt_base FROM x a JOIN x b ON a.src_ip = b.src_ip AND a.domain = b.domain AND b.i < a.i GROUP BY ALL),
z AS (SELECT x.*, coalesce(baseline, 0) AS baseline, CASE WHEN coalesce(baseline, 0) > 0 THEN names / baseline ELSE 1.0 END AS excess, txt_ratio - coalesce(txt_base, 0) AS txt_dev, CAST(i - 1 AS INT) AS windows FROM x LEFT JOIN y USING (src_ip, domain, bucket))"""


@query(f"WITH {ZONES} SELECT src_ip, domain, bucket, queries, names, CAST(txt AS BIGINT) AS txt, round(txt_ratio, 9) AS txt_ratio, round(baseline, 9) AS baseline, windows, round(excess, 9) AS excess, round(txt_dev, 9) AS txt_dev FROM z")
def dns_zone_features(t):
    return rounded(detectors.dns_zones(_queries(t), 7 * DAY), 9)


@query(f"WITH {ZONES} SELECT src_ip, domain, bucket, CASE WHEN domain = 'zone3' THEN 'cdn-wildcard-allowlist' END AS reason FROM z WHERE names >= 2 AND (windows < 2 OR excess >= 1.2) AND txt_ratio >= 0.3")
def dns_tunnel(t):
    quiet = t.spark.createDataFrame([("zone3",)], "domain string")
    return detectors.tunnel_rule(detectors.dns_zones(_queries(t), 7 * DAY), names=2, excess=1.2, wildcards=quiet).select("src_ip", "domain", "bucket", "reason")


@query(f"""WITH {P}, c AS (SELECT event_id, dst_ip, count(*) OVER (PARTITION BY dst_ip ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS ja4_count, count(*) OVER (PARTITION BY dst_ip, tcp_flags ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS pair_count FROM p)
SELECT event_id, ja4_count, round(pair_count / ja4_count, 4) AS pair_share, ja4_count >= 20 AND pair_count / ja4_count <= 0.15 AS outlier FROM c""")
def pair_outlier(t):
    return rounded(detectors.pair_outliers(_p(t), "dst_ip", "tcp_flags", ["ts_us", "event_id"])).select("event_id", "ja4_count", "pair_share", "outlier")


BEACON = f"""{P}, g AS (SELECT src_ip, event_id, ts_us, ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, event_id) AS gap FROM p),
r AS (SELECT src_ip, gap / 1e6 AS x, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us DESC, event_id DESC) AS rn FROM g WHERE gap >= 1000000), m AS (SELECT src_ip, avg(x) AS mu, stddev_pop(x) AS sd FROM r WHERE rn <= 64 GROUP BY 1)"""


@query(f"""WITH {BEACON} SELECT src_ip, count(*) AS samples, round(sum(x), 3) AS span, round(avg(x), 3) AS iat_mean, round(any_value(sd), 3) AS iat_std, round(any_value(sd) / avg(x), 3) AS iat_cv, round(avg(pow(x - mu, 3)) / pow(any_value(sd), 3), 3) AS iat_skew, round(avg(pow(x - mu, 4)) / pow(any_value(sd), 4) - 3, 3) AS iat_kurtosis
FROM r JOIN m USING (src_ip) WHERE rn <= 64 GROUP BY 1 HAVING count(*) >= 12""")
def beacon_features(t):
    return rounded(detectors.beacon_features(_p(t), ["src_ip"], "ts_us", "event_id"), 3)


@query()
def beacon_periodogram(t):
    return rounded(detectors.beacon_periods(_p(t), ["src_ip"], "ts_us", "event_id"))


@query(f"""WITH {FLOW} SELECT proto, lo_ip, lo_port, hi_ip, hi_port, session, first_us, duration, CAST(CASE WHEN initiator_is_lo THEN n_lo ELSE n_hi END AS BIGINT) AS pkts_fwd, CAST(CASE WHEN initiator_is_lo THEN n_hi ELSE n_lo END AS BIGINT) AS pkts_rev,
CAST(CASE WHEN initiator_is_lo THEN b_lo ELSE b_hi END AS BIGINT) AS bytes_fwd, CAST(CASE WHEN initiator_is_lo THEN b_hi ELSE b_lo END AS BIGINT) AS bytes_rev, flags_seen_bitmap, saw_syn, saw_syn_ack, saw_fin, saw_rst, initiator_is_lo, orientation_confidence, n_lo > 0 AND n_hi > 0 AS completeness_flag FROM i""")
def flow_table(t):
    return rounded(flows.flow_table(_p(t), 3 * DAY), 6)


@query(f"""WITH {FLOW} SELECT CASE WHEN proto = 17 AND (lo_port = 443 OR hi_port = 443) THEN 'quic' WHEN (lo_port IN (443, 8443, 853) OR hi_port IN (443, 8443, 853)) AND n_lo > 0 AND n_hi > 0 THEN 'opaque' WHEN n_lo > 0 AND n_hi > 0 AND orientation_confidence >= 1 THEN 'high' ELSE 'low' END AS cls, count(*) AS n FROM i GROUP BY 1""")
def coverage_classes(t):
    f = flows.flow_table(_p(t), 3 * DAY)
    return f.groupBy(flows.coverage_class(f).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FLOW} SELECT lo_ip, hi_ip, session, round(CASE WHEN pf > 0 THEN bf / pf ELSE 0 END, 4) AS bytes_per_pkt_fwd, round(CASE WHEN pr > 0 THEN br / pr ELSE 0 END, 4) AS bytes_per_pkt_rev, CASE WHEN pf > 0 AND pr > 0 THEN 'BIDIRECTIONAL' WHEN pf > 0 THEN 'FWD_ONLY' ELSE 'REV_ONLY' END AS directionality
FROM (SELECT *, CASE WHEN initiator_is_lo THEN n_lo ELSE n_hi END AS pf, CASE WHEN initiator_is_lo THEN n_hi ELSE n_lo END AS pr, CASE WHEN initiator_is_lo THEN b_lo ELSE b_hi END AS bf, CASE WHEN initiator_is_lo THEN b_hi ELSE b_lo END AS br FROM i)""")
def flow_structural(t):
    return rounded(flows.structural(flows.flow_table(_p(t), 3 * DAY))).select("lo_ip", "hi_ip", "session", "bytes_per_pkt_fwd", "bytes_per_pkt_rev", "directionality")


@query(f"""WITH {P}, w AS (SELECT src_ip, ts_us // {DAY} AS bucket, (max(ts_us) - min(ts_us)) / 1e6 AS window_duration_s, sum(CASE WHEN tcp_flags IN (2, 16) THEN 1 ELSE 0 END) AS packets_fwd, sum(CASE WHEN tcp_flags IN (2, 16) THEN 0 ELSE 1 END) AS packets_rev,
 sum(CASE WHEN tcp_flags IN (2, 16) THEN length ELSE 0 END) AS bytes_fwd, sum(CASE WHEN tcp_flags IN (2, 16) THEN 0 ELSE length END) AS bytes_rev, count(*) AS packets FROM p GROUP BY ALL HAVING count(*) >= 4)
SELECT src_ip, bucket, round(window_duration_s, 9) AS window_duration_s, packets, round(packets / greatest(window_duration_s, 1e-6), 9) AS packet_rate, round((bytes_fwd + bytes_rev) / packets, 9) AS mean_packet_size, round(packets_rev / packets, 9) AS reverse_packet_share FROM w""")
def novelty_windows(t):
    p = _p(t).withColumn("forward", F.col("tcp_flags").isin(2, 16))
    return rounded(detectors.novelty_windows(p, ["src_ip"], DAY), 9).select("src_ip", "bucket", "window_duration_s", "packets", "packet_rate", "mean_packet_size", "reverse_packet_share")


@query()
def feature_groups(t):
    """Every group's features by their registry names, one row a feature: how many rows carry it."""
    from flowmill.operators import features

    p = _p(t)
    groups = [features.flow_features(p, 3 * DAY), features.ddos(p, DAY, 7 * DAY), features.scan(p, (DAY, 7 * DAY, 28 * DAY)), features.exfil(_oriented(t), DAY, 7 * DAY), features.beacons(p, ["src_ip", "dst_ip"], "ts_us", "event_id", ("src_ip", "dst_ip")), features.dns(_queries(t), 7 * DAY)]
    out = None
    for g in groups:
        one = g.agg(*[F.count(c).alias(c) for c in g.columns]).unpivot([], g.columns, "name", "n")
        out = one if out is None else out.unionByName(one)
    return out


# the registry is a table of this package: tests hold it against the published names
@query()
def registry_drift(t):
    from flowmill.functions import features

    names = t.spark.createDataFrame([("duration",), ("splt_len",), ("not_a_feature",)], "name string")
    return features.unregistered(names)


@query()
def registry_counts(t):
    from flowmill.functions import features

    return features.registry(t.spark).agg(F.count(F.lit(1)).cast("int").alias("features"), F.count_if("model_input").cast("int").alias("model_inputs"))


@query()
def flow_export(t):
    return detectors.flow_export(_p(t), ["src_ip"], 12 * HOUR, 2 * DAY)


@query(f"""WITH {P}, f AS (SELECT dst_ip, src_ip, arg_min(tcp_flags, ts_us) AS family FROM p GROUP BY ALL), n AS (SELECT dst_ip, family, count(*) AS agreeing FROM f GROUP BY ALL)
SELECT dst_ip AS ja4, arg_max(family, agreeing * 100 + family) AS family, CAST(sum(agreeing) AS BIGINT) AS hosts, max(agreeing) AS agreeing, round(max(agreeing) / sum(agreeing), 6) AS confidence FROM n GROUP BY 1""")
def fingerprint_reference(t):
    p = _p(t).withColumnRenamed("dst_ip", "ja4")
    return rounded(detectors.fingerprint_reference(p, "ja4", "src_ip", "tcp_flags", "ts_us"), 6)


@query(f"""WITH {P} SELECT event_id, len(list_distinct(list(dst_port) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW))) AS n FROM p""")
def distinct_in_range(t):
    from flowmill.operators import features

    return _p(t).select("event_id", features.distinct_per(["src_ip"], "dst_port", "ts_us", DAY).cast("long").alias("n"))
