"""Queries on larger keys and awkward sums than the smallest tables hold, against their SQL."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from flowmill.operators import detectors, stats
from flowmill.plans import registry


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def rows_of_sql(folder, name):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'; SET threads = 1")
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    r = c.execute(registry.oracle_sql()[name])
    at = sorted(range(len(r.description)), key=lambda k: r.description[k][0])
    return sorted((tuple(x[k] for k in at) for x in r.fetchall()), key=repr)


def awkward_scores():
    """Fourteen scores whose mean is 0.3, under 0.3 when added one after the other."""
    rng = random.Random(4)
    while True:
        v = [rng.randint(0, 60) for _ in range(13)]
        v.append(14 * 30 - sum(v))
        scores, total = [x / 100 for x in v], 0.0
        for x in scores:
            total += x
        if 0 <= v[-1] <= 100 and total / 14 < 0.3:
            return scores


def test_f1_mean_scores_add_up_in_the_order_of_time(spark):
    scores = awkward_scores()
    rows = [(7, k, False, 0, 0, 1, f"zone{k % 5}", x) for k, x in enumerate(scores)] + [(7, 99, True, 3, 0, 1, "zone0", 5.0), (8, 1, True, 3, 0, 1, "zone0", 5.0)]
    total = 0.0
    for x in scores:
        total += x
    for order in range(4):
        random.Random(order).shuffle(rows)
        q = spark.createDataFrame(rows, "src_ip long, ts_us long, is_response boolean, rcode int, answers int, qtype int, domain string, score double").repartition(order + 1)
        f = detectors.dns_sources(q, 1000)
        assert {r["src_ip"]: r["mean_score"] for r in f.collect()} == {7: total / 14, 8: None}
        assert detectors.dga_rule(f, domains=5, queries=8, score=0.3, nx=0.2).collect()[0]["subtype"] == "dga-dictionary"


def test_f1_campaign_equals_its_sql_at_a_larger_size(spark, tmp_path):
    os.symlink("/root/testdata/sf0.1/events.parquet", tmp_path / "events.parquet")
    assert rows_of(registry.queries()["dga_campaign"](spark, str(tmp_path))) == rows_of_sql(tmp_path, "dga_campaign")


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """Events of 60,000 users, among them null and negative ones, and a type with nothing but nulls."""
    folder = tmp_path_factory.mktemp("many")
    user = F.when(F.col("id") % 997 == 0, None).when(F.col("id") % 5 == 0, -(F.col("id") % 12_000)).otherwise(F.col("id") % 60_000 * 1_000_003)
    kind = F.when(F.col("id") % 997 == 0, "none").otherwise(F.concat(F.lit("t"), (F.col("id") % 3).cast("string")))
    day = F.timestamp_seconds(1_704_067_200 + F.col("id") % 30 * 86_400).cast("timestamp_ntz")
    rows = spark.range(200_000).select(F.col("id").alias("event_id"), day.alias("ts"), user.alias("user_id"), kind.alias("event_type"))
    rows.toPandas().astype({"user_id": "Int64"}).to_parquet(folder / "events.parquet", coerce_timestamps="us")
    return folder


def test_f2_distinct_users_are_exact(spark, many_users):
    assert rows_of(registry.queries()["distinct_sketch"](spark, str(many_users))) == rows_of_sql(many_users, "distinct_sketch")


def test_f2_bitmaps_hold_any_whole_number(spark):
    ids = [-(1 << 63), (1 << 63) - 1, -1, -64, -65, 0, 63, 64, 1 << 40, None]
    df = spark.createDataFrame([(k, x) for k in (1, 1, 2) for x in ids] + [(3, None)], "k long, x long")
    maps = stats.bitmaps(df, ["k"], "x")
    assert sorted(map(tuple, stats.bitmap_counts(maps, ["k"], "n").collect())) == [(1, 9), (2, 9), (3, 0)]
    both = stats.merged_bitmaps(maps.unionByName(maps.filter("k = 2").withColumn("k", F.lit(1).cast("long"))), ["k"])
    assert sorted(map(tuple, stats.bitmap_counts(both, ["k"], "n").collect())) == [(1, 9), (2, 9), (3, 0)]


def test_f3_numbers_beyond_an_address_come_back_whole(spark, tmp_path):
    keys = [0, 1, 542_365, 542_366, 542_367, 900_000, 5_000_000_000, -1, -600_000, None]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").toPandas().astype("Int64").to_parquet(tmp_path / "customer.parquet")
    assert rows_of(registry.queries()["ip_roundtrip"](spark, str(tmp_path))) == rows_of_sql(tmp_path, "ip_roundtrip")


def test_f4_merged_days_count_users_exactly(spark, many_users):
    assert rows_of(registry.queries()["sketch_merge"](spark, str(many_users))) == rows_of_sql(many_users, "sketch_merge")
