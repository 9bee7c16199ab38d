"""Per-series ordered splits.

Positions are always ``row_number() OVER (PARTITION BY id ORDER BY ds)``;
no operator relies on the physical order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesspark.functions.contracts import DEFAULT, Cols


def _w(cols: Cols):
    return Window.partitionBy(cols.id).orderBy(cols.ds)


def position(cols: Cols = DEFAULT) -> Column:
    return F.row_number().over(_w(cols))


def series_length(cols: Cols = DEFAULT) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(cols.id))


def grid_positions(df: DataFrame, freq: str, cols: Cols = DEFAULT) -> DataFrame:
    """``_rn`` and ``_n`` from the grid index and one aggregate per series.

    Equal to ``row_number``/``count`` on a regular grid, without a window
    over the whole series: the per-series bounds are partially aggregated and
    joined back, so a hot series is not confined to one task.
    """
    from seriesspark.functions.frequency import step_index
    idx = step_index(F.col(cols.ds), freq)
    span = df.groupBy(cols.id).agg(F.min(idx).alias("_lo"), F.count(F.lit(1)).alias("_n"))
    return df.join(span, cols.id, "inner").withColumn("_rn", idx - F.col("_lo") + 1).drop("_lo")


def label_holdout(df: DataFrame, h: int, cols: Cols = DEFAULT, label_col: str = "split",
                  freq: str | None = None) -> DataFrame:
    """Label the last ``h`` rows of each series ``test``, the rest ``train``.

    A series with fewer than ``h`` rows is all ``test`` (no training rows),
    which is where the reference's list-length construction breaks. With
    ``freq`` (regular grid) positions come from ``grid_positions``.
    """
    if freq:
        pos = grid_positions(df, freq, cols)
        return pos.withColumn(label_col, F.when(F.col("_n") - F.col("_rn") < h, "test").otherwise("train")) \
            .drop("_n", "_rn")
    # a row is among the last h if none lies h rows after it: no count of the series, no buffer of its rows
    later = F.lead(F.lit(1), h).over(_w(cols))
    return df.withColumn(label_col, F.when(later.isNull(), "test").otherwise("train"))


def train_test(df: DataFrame, h: int, cols: Cols = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` frames of the holdout split."""
    labelled = label_holdout(df, h, cols, "_split")
    return (labelled.filter(F.col("_split") == "train").drop("_split"),
            labelled.filter(F.col("_split") == "test").drop("_split"))


def head_per_series(df: DataFrame, n: int, cols: Cols = DEFAULT, freq: str | None = None) -> DataFrame:
    """First ``n`` rows of every series (W2); ``freq`` uses ``grid_positions``."""
    if freq:
        return grid_positions(df, freq, cols).filter(F.col("_rn") <= n).drop("_rn", "_n")
    return df.withColumn("_rn", position(cols)).filter(F.col("_rn") <= n).drop("_rn")


def tail_per_series(df: DataFrame, n: int, cols: Cols = DEFAULT, freq: str | None = None) -> DataFrame:
    """Last ``n`` rows of every series (W1 ``tail``); ``freq`` uses ``grid_positions``."""
    if freq:
        pos = grid_positions(df, freq, cols)
        return pos.filter(F.col("_n") - F.col("_rn") < n).drop("_rn", "_n")
    from_end = series_length(cols) - position(cols)
    return df.withColumn("_fe", from_end).filter(F.col("_fe") < n).drop("_fe")


def ordered_split(df: DataFrame, train_frac: float = 0.9, cols: Cols = DEFAULT,
                  label_col: str = "split", freq: str | None = None) -> DataFrame:
    """Ordered split: first ``int(frac * n)`` rows of each series train.

    Per series instead of one global window, which would put every row in
    one task; with ``freq`` (regular grid) positions come from
    ``grid_positions`` so no series is confined to one task either.
    """
    if freq:
        pos = grid_positions(df, freq, cols)
        return pos.withColumn(label_col, F.when(F.col("_rn") <= F.floor(F.lit(train_frac) * F.col("_n")), "train")
                              .otherwise("valid")).drop("_rn", "_n")
    cut = F.floor(F.lit(train_frac) * series_length(cols))
    return df.withColumn(label_col, F.when(position(cols) <= cut, "train").otherwise("valid"))


def cv_cutoffs(df: DataFrame, h: int, n_windows: int, step: int | None = None,
               cols: Cols = DEFAULT) -> DataFrame:
    """Rolling-origin cutoffs per series.

    ``c_i = n - h - step * (n_windows - 1 - i)`` for ``i = 0..n_windows-1``
    (``step`` defaults to ``h``). Returns ``(id, window, cutoff_rn, cutoff)``
    where ``cutoff`` is the timestamp of row ``cutoff_rn``; series whose first
    cutoff would be before row 1 are excluded.
    """
    step = h if step is None else step
    n, rn = series_length(cols), position(cols)
    back = F.col("_n") - h - F.col("_rn")
    ranked = df.select(cols.id, cols.ds, rn.alias("_rn"), n.alias("_n"))
    return (ranked
            .filter((back >= 0) & (back % step == 0) & (back < step * n_windows)
                    & (F.col("_n") - h - F.lit(step * (n_windows - 1)) >= 1))
            .select(cols.id, (F.lit(n_windows - 1) - back / step).cast("int").alias("window"),
                    F.col("_rn").alias("cutoff_rn"), F.col(cols.ds).alias("cutoff")))
