"""Aggregates: histograms, quantiles, robust scales, divergence, bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import scalar


def log_bucket(x: Column, per_decade: int = 20, unit: float = 1000.0) -> Column:
    """Bucket of a logarithmic histogram; 0 for values of up to ``unit``."""
    return F.when(x <= unit, 0).otherwise(F.floor(F.log10(x / unit) * per_decade) + 1).cast("int")


def log_histogram(df: DataFrame, x: Column, per_decade: int = 20, unit: float = 1000.0) -> DataFrame:
    return df.groupBy(log_bucket(x, per_decade, unit).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_quantile(hist: DataFrame, q: float, per_decade: int = 20, unit: float = 1000.0) -> DataFrame:
    """(value): quantile by linear interpolation in the bucket it falls in.  hist: (bucket, n), one row a bucket."""
    w = Window.orderBy("bucket")
    h = hist.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    hit = h.filter(F.col("upto") >= q * F.col("total")).agg(F.min_by(F.struct("bucket", "n", "upto", "total"), "bucket").alias("h")).select("h.*")
    low = F.when(F.col("bucket") == 0, 0.0).otherwise(unit * F.pow(F.lit(10.0), (F.col("bucket") - 1) / per_decade))
    high = unit * F.pow(F.lit(10.0), F.col("bucket") / per_decade)
    return hit.select((low + (high - low) * (q * F.col("total") - (F.col("upto") - F.col("n"))) / F.col("n")).alias("value"))


def nearest_rank(values: Column, q: float) -> Column:
    """Aggregate: the element of rank round(q * (n - 1)) of the sorted group."""
    return scalar.let(F.array_sort(F.collect_list(values)), lambda a: F.element_at(a, (F.bround(q * (F.size(a) - 1), 0).cast("int") + 1)))


def robust_scale(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Median and scaled median absolute deviation by key."""
    mid = df.groupBy(*keys).agg(F.median(x).alias("median"))
    return df.join(mid, keys).groupBy(*keys, "median").agg((F.median(F.abs(F.col(x) - F.col("median"))) * 1.4826).alias("mad"))


def js_from_uniform(df: DataFrame, keys: list[str], x: Column, bins: int = 10) -> DataFrame:
    """Jensen-Shannon divergence (bits) of values in [0, 1] from the uniform distribution over ``bins`` bins."""
    b = F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int")
    n = df.groupBy(*keys, b.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_p", F.col("_n") / F.sum("_n").over(Window.partitionBy(*keys)))
    u, p = 1.0 / bins, F.col("_p")
    m = (p + u) / 2
    part = 0.5 * p * F.log2(p / m) + 0.5 * u * F.log2(u / m)
    empty = 0.5 * u  # an empty bin: 0.5 * u * log2(u / (u / 2))
    return n.groupBy(*keys).agg((F.sum(part) + (bins - F.count(F.lit(1))) * empty).alias("js"))


#: Fixed value: the characters of names, their start and their end.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-^$"


def bigram_model(df: DataFrame, name: str) -> DataFrame:
    """(bigram, logp): Laplace-smoothed log probability of a bigram's second character given its first, of every pair of
    ALPHABET: a table of fixed size."""
    pairs = df.select(F.explode(scalar.bigrams(F.col(name))).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))
    letters = F.array(*map(F.lit, ALPHABET))
    every = df.sparkSession.range(1).select(F.explode(letters).alias("_f")).select("_f", F.explode(letters).alias("_s")).select("_f", F.concat("_f", "_s").alias("bigram"))
    counted = every.join(pairs, "bigram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("_f"))
    return counted.select("bigram", F.log((F.col("n") + 1.0) / (total + len(ALPHABET))).alias("logp"))


def bigram_score(df: DataFrame, name: str, model: DataFrame) -> DataFrame:
    """df's distinct names with the mean log probability of their bigrams (the alphabet bounds the model's size)."""
    each = df.select(name).distinct().select(name, F.explode(scalar.bigrams(F.col(name))).alias("bigram"))
    return each.join(F.broadcast(model), "bigram").groupBy(name).agg(F.avg("logp").alias("bigram_ll"))


def count_min(df: DataFrame, item: Column, part: Column, depth: int = 5, width: int = 1 << 14) -> DataFrame:
    """(part, row, cell, n): a count-min sketch of ``item`` for each part, as rows of its cells that are not 0; sketches merge
    by adding cells, so counting combines before its shuffle and a sketch has at most depth * width cells."""
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda r: F.struct(r.alias("row"), F.pmod(F.xxhash64(item, r), F.lit(width)).alias("cell")))).alias("c")
    return df.select(part.alias("part"), cells).groupBy("part", F.col("c.row").alias("row"), F.col("c.cell").alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def merged_sketch(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("row", "cell").agg(F.sum("n").alias("n"))


def estimates(items: DataFrame, item: str, sketch: DataFrame, depth: int = 5, width: int = 1 << 14) -> DataFrame:
    """(item, n): the least cell of each item; never below its count."""
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda r: F.struct(r.alias("row"), F.pmod(F.xxhash64(F.col(item), r), F.lit(width)).alias("cell")))).alias("c")
    e = items.select(item).distinct().select(item, at).select(item, "c.*").join(sketch, ["row", "cell"], "left")
    return e.groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))


def frequencies(df: DataFrame, item: str, part: Column) -> DataFrame:
    """(item, n) from one sketch a part, merged."""
    return estimates(df, item, merged_sketch(count_min(df, F.col(item), part)))


def bitmaps(df: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """(keys, word, bits): the set of whole numbers ``ids`` of each key as words of 64 bits.  Sets are exact, combine before
    their shuffle and merge by ``bit_or``; a word takes a row, so dense ids take a 64th of their number.  A key with nothing
    but nulls keeps a row without a word."""
    n = F.col(ids).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), n.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return df.groupBy(*keys, F.shiftright(n, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def merged_bitmaps(maps: DataFrame, keys: list[str]) -> DataFrame:
    return maps.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def bitmap_counts(maps: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the size of each key's set; maps has one row a word."""
    return maps.groupBy(*keys).agg(F.sum(F.coalesce(F.bit_count("bits"), F.lit(0))).alias(name))
