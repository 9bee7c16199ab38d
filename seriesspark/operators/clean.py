"""Cleaning: outlier masking and missing-value fills.

Percentile bounds are computed per series by one aggregate; the bounds table
has one row per series and is joined back on the series key, so its size is
bounded by the number of series, never by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesspark.functions.contracts import DEFAULT, Cols


def series_percentiles(df: DataFrame, lo: float, hi: float, cols: Cols = DEFAULT,
                       exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Per-series percentiles ``(id, q_lo, q_hi)``.

    ``exact=True`` interpolates linearly between order statistics (same as
    DuckDB ``quantile_cont``) with ``quantiles.exact_quantiles``, which never
    buffers a whole series; ``exact=False`` returns the bounded
    ``percentile_approx`` sketch values.
    """
    if exact:
        from seriesspark.operators.quantiles import exact_quantiles
        q = exact_quantiles(df, [cols.id], cols.y, [lo, hi], accuracy)
        return q.groupBy(cols.id).agg(F.max(F.when(F.col("q") == lo, F.col("quantile"))).alias("q_lo"),
                                      F.max(F.when(F.col("q") == hi, F.col("quantile"))).alias("q_hi"))
    q = F.percentile_approx(F.col(cols.y), [lo, hi], accuracy)
    return (df.groupBy(cols.id).agg(q.alias("_q"))
            .select(cols.id, F.col("_q")[0].alias("q_lo"), F.col("_q")[1].alias("q_hi")))


def mask_outliers(df: DataFrame, cols: Cols = DEFAULT, lo: float = 0.05, hi: float = 0.95,
                  k: float = 1.5, excluded: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Set ``y`` to NULL outside ``[q_lo - k*(q_hi-q_lo), q_hi + k*(q_hi-q_lo)]``.

    The defaults are the reference's: its ``Q1``/``Q3`` are the 5th and 95th
    percentiles. Series listed in ``excluded`` are left unchanged.
    """
    bounds = series_percentiles(df, lo, hi, cols, exact)
    j = df.join(bounds, cols.id, "left")
    iqr = F.col("q_hi") - F.col("q_lo")
    out_of = (F.col(cols.y) < F.col("q_lo") - k * iqr) | (F.col(cols.y) > F.col("q_hi") + k * iqr)
    keep = F.col(cols.id).isin(excluded) if excluded else F.lit(False)
    return j.withColumn(cols.y, F.when(~keep & out_of, F.lit(None).cast("double")).otherwise(F.col(cols.y))) \
            .drop("q_lo", "q_hi")


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing to 0."""
    return df.na.fill(0, subset=columns)
