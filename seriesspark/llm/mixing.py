"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies ``e`` (its source's target over
its source's size). ``floor(e)`` copies are certain. The fraction ``f`` left is
an inclusion probability: documents are ranked by random odds over inclusion
odds, ``(u / (1 - u)) / (f / (1 - f))``, and the first of the ranking are taken
until the sample has its fixed size. The size is measured in ``size`` units
(words), so a source lands within half a document of its target.

Defined cases: a null text has size 0; a null source is a source of its own,
last in the order; documents of size 0 take nothing; repeated rows are ranked as
separate documents with the same random number (ties broken by id and size); an
empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, running_totals


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a keyed hash; the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    All sizes are shared out by weight; a source stops at ``max_repeat`` times
    its size and the excess is reshared by weight among the others. This is
    filling to a common level: ``target = min(cap, level * weight)``. Sorted by
    ``cap / weight``, with the sources before it at their caps, each source gives
    a candidate level; the level is the largest one not above its own ratio.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = running_totals(src, [F.col("source").asc_nulls_last()], {"pos": F.lit(1)}, name="sources")
    w = F.array(*[F.lit(float(x)) for x in weights])
    src = src.withColumn("weight", F.element_at(w, (F.col("pos") % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    src = src.withColumn("ratio", F.col("cap") / F.col("weight"))
    src = running_totals(src, [F.col("ratio"), F.col("source").asc_nulls_last()],
                         {"cap_before": F.col("cap"), "weight_before": F.col("weight")}, name="levels")
    src = materialize(src, "targets")
    total, all_weights = src.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(total or 0)) - F.col("cap_before")) / (F.lit(float(all_weights or 1)) - F.col("weight_before"))
    top = src.agg(F.max(F.when(level <= F.col("ratio"), level))).first()[0]
    return src.select("source", "source_size",
                      F.least(F.col("cap"), F.lit(float(top or 0)) * F.col("weight")).alias("target"))


def pareto_mix(docs: DataFrame, size: Column, *, source: str = "source", key: str = "doc_id",
               weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3, seed: str = "mix",
               propensity: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Copies of each document: ``key, size, source_size, target, expected, copies, taken``.

    ``propensity`` tilts the expected copies within a source (for instance a
    quality score); without it all documents of a source have the same. ``carry``
    names further columns of ``docs`` to keep. Expected copies never exceed
    ``max_repeat``.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"),
                       size.cast("long").alias("size"),
                       (F.lit(1.0) if propensity is None else propensity.cast("double")).alias("_p"),
                       *[F.col(c).alias(f"_carry_{c}") for c in carry])
    rows = materialize(rows, "sizes")
    targets = source_targets(rows, weights, max_repeat)
    mass = rows.groupBy("source").agg(F.sum(F.col("_p") * F.col("size")).alias("_mass"))
    targets = targets.join(mass.withColumnRenamed("source", "_s"), targets["source"].eqNullSafe(F.col("_s"))).drop("_s")
    targets = targets.withColumnRenamed("source", "_s")
    rows = rows.join(targets, rows["source"].eqNullSafe(F.col("_s")), "left").drop("_s")
    expected = F.when(F.col("_mass") > 0, F.least(F.lit(float(max_repeat)), F.col("target") * F.col("_p") / F.col("_mass")))
    rows = rows.withColumn("expected", F.coalesce(expected, F.lit(0.0)))
    rows = rows.withColumn("_whole", F.floor("expected")).withColumn("_f", F.col("expected") - F.col("_whole"))
    u = uniform(F.col("doc_id"), seed)
    odds = (u / (1 - u)) / (F.col("_f") / (1 - F.col("_f")))
    rows = rows.withColumn("_key", F.when(F.col("_f") > 0, odds))  # null: no chance, ranked last
    rows = running_totals(rows, [F.col("source").asc_nulls_last(), F.col("_key").asc_nulls_last(),
                                 F.col("doc_id"), F.col("size")],
                          {"_before": F.col("size")}, by=["source"], name="ranking")
    certain = rows.groupBy("source").agg(F.sum(F.col("_whole") * F.col("size")).alias("_certain")) \
        .withColumnRenamed("source", "_s")
    rows = rows.join(certain, rows["source"].eqNullSafe(F.col("_s")), "left").drop("_s")
    room = F.col("target") - F.col("_certain")
    drawn = F.col("_key").isNotNull() & (2 * F.col("_before") + F.col("size") <= 2 * room)
    rows = rows.withColumn("copies", (F.col("_whole") + drawn.cast("long")).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", "expected", "copies",
                       (F.col("copies") * F.col("size")).alias("taken"),
                       *[F.col(f"_carry_{c}").alias(c) for c in carry])
