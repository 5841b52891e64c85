"""Rule bitmask ledger: every rule once for each document, then policies as masks over the stored bits.

``ledger`` adds the measurements and ``bits`` (bit i: rule i failed).  ``apply_policy`` reads a version of POLICIES as
a mask; ``ablation`` folds the ledger to one row a bit pattern and works on those rows alone.  All of it is built-in
expressions, no shuffle before the ablation's count.

Rows: null, empty and blank texts have no words and fail ``few_words`` alone; repeated rows, null ids and other columns
stay as they are, but columns of the names in MEASURES and ``bits`` are replaced; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _c(name: str) -> Column:
    return F.col(name)


#: Rule i is bit i.  Limits are whole numbers, so that any engine agrees on them.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: _c("n_words") < 50,
    "repeated_words": lambda: 100 * _c("n_repeat_words") > 50 * _c("n_words"),
    "symbols": lambda: 100 * _c("n_symbols") > 10 * _c("n_words"),
    "repeated_lines": lambda: 100 * _c("n_dup_lines") > 50 * _c("n_lines"),
    "short_words": lambda: 10 * _c("word_chars") < 25 * _c("n_words"),
    "long_words": lambda: _c("word_chars") > 12 * _c("n_words"),
}
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[int, tuple[str, ...]] = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
}
BASE, CURRENT = 1, 2


def mask(version: int) -> int:
    names = list(RULES)
    return sum(1 << names.index(x) for x in POLICIES[version])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Number of words inside three-word windows that the text holds twice or more."""

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
            hit = F.filter(same, lambda i: i.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(placed, twins)).otherwise(F.lit(0))

    return F.when(F.size(words) >= 4, let(hashes(words), covered)).otherwise(F.lit(0))


def measure(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda x: x != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).cast("long").alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    out = docs.withColumns({"_of_words": let(words, of_words), "_of_lines": let(lines, of_lines), "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long")})
    fields = {"n_words": "_of_words", "word_chars": "_of_words", "n_lines": "_of_lines", "n_dup_lines": "_of_lines", "n_repeat_words": "_of_words"}
    return out.withColumns({k: F.col(v)[k] for k, v in fields.items()}).drop("_of_words", "_of_lines")


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements and the failure bits of all rules."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(rule(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs).withColumn("bits", bits)


def passes(version: int = CURRENT) -> Column:
    return F.col("bits").bitwiseAND(F.lit(mask(version)).cast("long")) == 0


def apply_policy(ledger_: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger's rows with base_failed (policy BASE) and kept (policy BASE and policy ``version``)."""
    return ledger_.withColumns({"base_failed": ~passes(BASE), "kept": passes(BASE) & passes(version)})


def ablation(ledger_: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy keeps without it."""
    names = list(RULES)
    patterns = ledger_.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    used = [(x, 1 << names.index(x)) for x in POLICIES[version]]
    rule = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(b).cast("long").alias("bit")) for x, b in used])).alias("r")
    m = F.lit(mask(version)).cast("long")
    rows = patterns.select("bits", "n", rule).select("bits", "n", "r.rule", "r.bit")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits").bitwiseAND(m) == F.col("bit")
    without = F.col("bits").bitwiseAND(m.bitwiseXOR(F.col("bit"))) == 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return rows.groupBy("rule", "bit").agg(total(failed).alias("n_failed"), total(alone).alias("n_alone"), total(without).alias("n_kept_without"))
