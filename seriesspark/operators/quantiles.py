"""Exact per-group quantiles without buffering a group.

``percentile`` keeps every value of a group in one buffer, so a series
holding a third of all rows would need that much memory in one task. Here a
bounded ``percentile_approx`` sketch (rank error at most ``n / accuracy``)
first brackets each target rank; rows below the bracket are only counted
(partially aggregated), and only the rows inside the bracket, about
``4 n / accuracy`` of them, are ranked by a sort-based window that spills.
Groups smaller than ``4 * accuracy`` rows are ranked whole.
The two order statistics around ``q * (n - 1)`` are then interpolated
linearly, as ``percentile`` and DuckDB ``quantile_cont`` do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs, accuracy: int = 10000) -> DataFrame:
    """``(keys..., q, quantile)`` for every group and every ``q`` in ``qs``."""
    eps = 2.0 / accuracy
    probs = []
    for q in qs:
        probs += [max(0.0, q - eps), min(1.0, q + eps)]
    clean = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    stats = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                     F.percentile_approx("_v", probs, accuracy).alias("_br"))
    # Groups under 4 * accuracy rows are ranked whole (a constant bound); in
    # larger ones the margin 2n/accuracy exceeds the sketch's rank error
    # n/accuracy plus one, so both order statistics lie inside the bracket.
    small, m = F.col("_n") < 4 * accuracy, len(qs)
    bound = lambda i, far: F.when(small, F.lit(far)).otherwise(F.col("_br")[i])
    stats = stats.select(*keys, "_n", *[bound(2 * i, float("-inf")).alias(f"_lo{i}") for i in range(m)],
                         *[bound(2 * i + 1, float("inf")).alias(f"_hi{i}") for i in range(m)])
    tagged = clean.join(stats, keys, "inner")
    v = F.col("_v")
    within = [(v >= F.col(f"_lo{i}")) & (v <= F.col(f"_hi{i}")) for i in range(m)]
    in_any = within[0]
    for w in within[1:]:
        in_any = in_any | w
    # per bracket: all rows below it, and those of them that are ranked (inside another bracket)
    skipped = tagged.groupBy(*keys).agg(*[F.sum(F.when((v < F.col(f"_lo{i}")) & ~in_any, 1).otherwise(0)).alias(f"_skip{i}") for i in range(m)])
    # every row of a bracket is ranked once, whatever the number of quantiles
    ranked = tagged.filter(in_any).join(skipped, keys, "inner") \
        .withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1)
    position = [F.lit(float(q)) * (F.col("_n") - 1) for q in qs]
    at = lambda i, rank: F.max(F.when(within[i] & (F.col("_r") + F.col(f"_skip{i}") == rank), v))
    out = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *[x for i in range(m) for x in (
        at(i, F.floor(position[i])).alias(f"_lv{i}"), at(i, F.ceil(position[i])).alias(f"_hv{i}"))])

    def interpolated(i: int):
        frac = position[i] - F.floor(position[i])
        return F.when(frac == 0, F.col(f"_lv{i}")).otherwise((1 - frac) * F.col(f"_lv{i}") + frac * F.col(f"_hv{i}"))

    # every group and q must have both order statistics: a bracket that missed one is an error, not a gap
    missed = F.raise_error(F.concat(F.lit("quantile bracket missed its rank for "), F.to_json(F.struct(*keys, "_n")))).cast("double")
    per_q = F.array(*[F.struct(F.lit(float(q)).alias("q"), interpolated(i).alias("value")) for i, q in enumerate(qs)])
    return stats.select(*keys).join(out, keys, "left").withColumn("_e", F.explode(per_q)) \
        .select(*keys, F.col("_e.q").alias("q"), F.coalesce(F.col("_e.value"), missed).alias("quantile"))
