"""Join types and join shapes."""

from pyspark.sql import functions as F

from flowmill.operators import joins
from flowmill.plans.registry import query
from flowmill.sources.packets import EVENTS_AS_PACKETS_SQL, events_as_packets

P = f"p AS ({EVENTS_AS_PACKETS_SQL})"
DAY = 86_400_000_000


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def join_inner(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).filter("c_acctbal > 0").select("o_orderkey", "c_name")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_left(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(t):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def join_full(t):
    return t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"), "full").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT r_name, n_name, r_regionkey = n_regionkey AS same FROM region CROSS JOIN nation")
def join_cross_small(t):
    return t.region.crossJoin(F.broadcast(t.nation)).select("r_name", "n_name", (F.col("r_regionkey") == F.col("n_regionkey")).alias("same"))


@query("SELECT n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def join_broadcast_ref(t):
    per = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total"))
    r = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return per.join(r, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query(f"""WITH {P}, i AS (SELECT dst_ip AS host, ts_us // {DAY} AS day, count(*) AS n_in FROM p GROUP BY ALL), o AS (SELECT src_ip AS host, ts_us // {DAY} AS day, count(*) AS n_out FROM p GROUP BY ALL)
SELECT host, day, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM i FULL JOIN o USING (host, day)""")
def join_self_egress(t):
    side = F.explode(F.array(F.struct(F.col("dst_ip").alias("host"), F.lit(1).alias("i")), F.struct(F.col("src_ip").alias("host"), F.lit(0).alias("i")))).alias("e")
    p = events_as_packets(t.events).select(F.floor(F.col("ts_us") / DAY).alias("day"), side)
    return p.groupBy("e.host", "day").agg(F.sum("e.i").cast("long").alias("n_in"), F.sum(1 - F.col("e.i")).cast("long").alias("n_out"))


RANGES = f"""r AS (SELECT o_orderkey AS rank, 'window-' || (o_orderkey % 5) AS label, 1704067200000000 + (o_orderkey % 60) * {DAY // 2} AS a, 1704067200000000 + (o_orderkey % 60) * {DAY // 2} + {DAY // 6} AS b FROM orders)"""


@query(f"WITH {P}, {RANGES} SELECT event_id, coalesce((SELECT arg_min(label, rank) FROM r WHERE a <= ts_us AND ts_us <= b), 'benign') AS label FROM p")
def join_interval_label(t):
    a = F.lit(1704067200000000) + (F.col("o_orderkey") % 60) * (DAY // 2)
    r = t.orders.select(F.col("o_orderkey").alias("rank"), F.concat(F.lit("window-"), (F.col("o_orderkey") % 5).cast("string")).alias("label"), a.alias("a"), (a + DAY // 6).alias("b"))
    return joins.first_label(events_as_packets(t.events).select("event_id", "ts_us"), r, "event_id", "ts_us", "a", "b", "label", "rank", DAY).select("event_id", "label")


@query("""WITH n(cidr, port, reason, rank, lo, hi) AS (VALUES ('10.0.0.0/8', 0, 'private', 2, 167772160, 184549375), ('10.2.0.0/16', 443, 'backup', 1, 167903232, 167968767), ('10.9.4.0/30', 0, 'probe', 0, 168363008, 168363011)),
i AS (SELECT c_custkey, 167772160 + c_custkey * 65537 % 33554432 AS ip, CASE WHEN c_custkey % 2 = 0 THEN 443 ELSE 80 END AS dst_port FROM customer)
SELECT c_custkey, (SELECT arg_min(reason, rank) FROM n WHERE ip BETWEEN lo AND hi AND (n.port = 0 OR n.port = dst_port)) AS reason FROM i""")
def join_cidr_range(t):
    nets = t.spark.createDataFrame([("10.0.0.0/8", [], "private", 2), ("10.2.0.0/16", [443], "backup", 1), ("10.9.4.0/30", [], "probe", 0)], "cidr string, ports array<int>, reason string, rank int")
    i = t.customer.select("c_custkey", (167772160 + F.col("c_custkey") * 65537 % 33554432).alias("ip"), F.when(F.col("c_custkey") % 2 == 0, 443).otherwise(80).alias("dst_port"))
    return joins.cidr_join(i, nets, "ip", "dst_port").select("c_custkey", "reason")


HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@query(f"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages), d(domain) AS (VALUES ('example.com'), ('example.net'), ('m.example.org'), ('org'))
SELECT page_id, (SELECT arg_max(domain, length(domain)) FROM d WHERE host = domain OR ends_with(host, '.' || domain)) AS matched FROM h""")
def join_suffix(t):
    h = t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"))
    d = t.spark.createDataFrame([("example.com",), ("example.net",), ("m.example.org",), ("org",)], "domain string")
    return joins.suffix_join(h, d, "host", "domain").select("page_id", "matched")


@query(f"""WITH {P}, f AS (SELECT src_ip, ts_us, arg_max(length, event_id) AS length FROM p WHERE tcp_flags = 4 GROUP BY ALL)
SELECT p.event_id, CASE WHEN p.ts_us - f.ts_us <= {DAY} THEN f.length END AS held FROM p ASOF LEFT JOIN f ON p.src_ip = f.src_ip AND p.ts_us >= f.ts_us""")
def join_asof_hold(t):
    p = events_as_packets(t.events)
    return joins.hold(p, ["src_ip"], "ts_us", F.col("tcp_flags") == 4, F.col("length"), DAY, ["event_id"]).select("event_id", "held")


@query(f"""WITH {P} SELECT event_id, coalesce(last_value(CASE WHEN tcp_flags = 2 THEN length END IGNORE NULLS) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING),
last_value(CASE WHEN tcp_flags = 2 THEN length END IGNORE NULLS) OVER (PARTITION BY src_ip ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)) AS known FROM p""")
def join_last_known(t):
    p = events_as_packets(t.events).withColumn("v", F.when(F.col("tcp_flags") == 2, F.col("length")))
    return joins.last_known(p, ["src_ip", "dst_ip"], ["src_ip"], ["ts_us", "event_id"], "v").select("event_id", "known")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 >= 8 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 < 8)")
def strict_split_anti(t):
    o = t.orders.select("o_orderkey", "o_custkey")
    return o.filter("o_orderkey % 10 >= 8").join(o.filter("o_orderkey % 10 < 8").select("o_custkey"), "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT count(*) AS shared FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 10 < 8 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 10 >= 8)")
def leakage_overlap(t):
    o = t.orders.select("o_orderkey", "o_custkey")
    return o.filter("o_orderkey % 10 < 8").select("o_custkey").intersect(o.filter("o_orderkey % 10 >= 8").select("o_custkey")).agg(F.count(F.lit(1)).alias("shared"))


@query("""WITH a AS (SELECT c_custkey AS id, c_mktsegment AS doc FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE c_mktsegment END AS doc FROM customer WHERE c_custkey % 5 <> 0)
SELECT id, CASE WHEN a.id IS NULL THEN 'only_second' WHEN b.id IS NULL THEN 'only_first' ELSE 'differs' END AS state FROM a FULL JOIN b USING (id) WHERE a.id IS NULL OR b.id IS NULL OR a.doc <> b.doc""")
def reconcile_full_outer(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("doc"))
    return joins.reconcile(c.filter("id % 7 <> 0"), c.filter("id % 5 <> 0").withColumn("doc", F.when(F.col("id") % 11 == 0, "x").otherwise(F.col("doc"))), "id", "doc")
