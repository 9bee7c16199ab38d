"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: its measurement is stored and its
failure is one bit of ``failures``. A policy is a versioned set of rules, that
is a bit mask; applying a policy, or asking what it would keep without one of
its rules, reads only the ledger. Ablations first count equal bit patterns (at
most 2^rules of them) and then work on those counts with bitwise operations.

Defined cases: a null text has no words and fails ``few_words``; repeated rows
give repeated ledger rows; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, count_chars, let

# Rules in bit order, as SQL conditions on the measurements.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars > 12 * n_words OR word_chars < 2 * n_words",
    "capitals": "2 * n_upper > word_chars",
}
BASE = ("few_words", "repeated_words")
# Policies by version. A policy always holds the base rules.
POLICIES = {
    "base": BASE,
    "v1": BASE + ("symbols", "repeated_lines"),
    "v2": BASE + ("symbols", "repeated_lines", "word_length", "capitals"),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules) -> int:
    return sum(bit(r) for r in rules)


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text.

    Windows are hashed and sorted with their positions, equal neighbours mark
    repeats, and the marked positions in order give the covered length; so a
    long text costs its sort, not a comparison of all windows.
    """
    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
                           F.lit(0), lambda a, x: a + x)

    def marked(runs: Column) -> Column:
        same = F.filter(runs, lambda r, i: (r["h"] == F.get(runs, i + 1)["h"]) | ((i > 0) & (r["h"] == F.get(runs, i - 1)["h"])))
        return F.sort_array(F.transform(same, lambda r: r["p"]))

    def windows(h: Column) -> Column:
        every = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, h[i + 1], h[i + 2]))
        return let(every, lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), F.sort_array(
            F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    runs = let(hashes, windows)
    return F.coalesce(let(let(runs, marked), covered), F.lit(0))


def ledger(docs: DataFrame, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and failure bits per document, with the ``carry`` columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*[F.col(c).alias(f"_carry_{c}") for c in carry],
                    F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_words"),
                    F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("_lines"),
                    count_chars(t, "#*$%&|<>").alias("n_symbols"),
                    count_chars(t, r"\p{Lu}").alias("n_upper"))
    d = d.select(*[F.col(f"_carry_{c}").alias(c) for c in carry],
                 F.size("_words").cast("long").alias("n_words"),
                 F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                 "n_symbols", "n_upper",
                 F.size("_lines").cast("long").alias("n_lines"),
                 (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                 repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"))
    failures = F.lit(0)
    for rule, condition in RULES.items():
        failures = failures + F.when(F.expr(condition), bit(rule)).otherwise(0)
    return d.withColumn("failures", failures.cast("long"))


def apply_policy(rows: DataFrame, version: str = "v2") -> DataFrame:
    """Add ``base_failed`` and ``kept`` from the stored bits."""
    rejects = F.col("failures").bitwiseAND(F.lit(mask(POLICIES[version])))
    return rows.withColumn("base_failed", F.col("failures").bitwiseAND(F.lit(mask(BASE))) != 0) \
        .withColumn("kept", rejects == 0)


def ablations(rows: DataFrame, version: str = "v2") -> DataFrame:
    """Per rule of a policy: documents failing it, rejected by it alone, and kept without it."""
    rules = POLICIES[version]
    patterns = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask(rules))).alias("bits")).agg(F.count("*").alias("n"))
    r = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(bit(x)).cast("long").alias("bit")) for x in rules]))
    p = patterns.select("bits", "n", r.alias("r"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    others = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    return p.groupBy(F.col("r.rule").alias("rule")).agg(
        count(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failing"),
        count(F.col("bits") == F.col("r.bit")).alias("rejected_alone"),
        count(others == 0).alias("kept_without"))
