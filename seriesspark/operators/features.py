"""Leak-free lag features (W6-W10, X7, P14, U4, J13, F15 preprocessing).

Every feature at row t uses only rows strictly before t: frames end at
``-k``, never at the current row. All features of one call share
``Window.partitionBy(id).orderBy(ds)``, so Spark plans a single shuffle and a
single sort for the whole feature set. Lags count rows, so they equal time
lags only on a regular grid: gap-fill first (``grid.fill_grid``).

Feature names follow the reference's payload: ``lag{k}``,
``expanding_mean_lag{k}``, ``rolling_mean_lag{k}_window_size{w}``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesspark.functions.contracts import DEFAULT, Cols
from seriesspark.functions.frequency import days_in_month


@dataclass(frozen=True)
class ExpandingMean:
    """Mean of rows ``1 .. t-k`` (NULL when ``t <= k``)."""

    def name(self, lag: int) -> str:
        return f"expanding_mean_lag{lag}"

    def column(self, y: str, lag: int, w) -> Column:
        return F.avg(F.col(y)).over(w.rowsBetween(Window.unboundedPreceding, -lag))


@dataclass(frozen=True)
class RollingMean:
    """Mean of rows ``t-k-w+1 .. t-k``; NULL unless all ``w`` rows are non-null."""

    window_size: int

    def name(self, lag: int) -> str:
        return f"rolling_mean_lag{lag}_window_size{self.window_size}"

    def column(self, y: str, lag: int, w) -> Column:
        frame = w.rowsBetween(-(lag + self.window_size - 1), -lag)
        return F.when(F.count(F.col(y)).over(frame) == self.window_size, F.avg(F.col(y)).over(frame))


@dataclass(frozen=True)
class RollingStd:
    """Sample standard deviation over the same frame as ``RollingMean``."""

    window_size: int

    def name(self, lag: int) -> str:
        return f"rolling_std_lag{lag}_window_size{self.window_size}"

    def column(self, y: str, lag: int, w) -> Column:
        frame = w.rowsBetween(-(lag + self.window_size - 1), -lag)
        return F.when(F.count(F.col(y)).over(frame) == self.window_size, F.stddev_samp(F.col(y)).over(frame))


# Calendar feature names the reference uses.
DATE_FEATURES = {
    "quarter": lambda ds: F.quarter(ds),
    "daysinmonth": lambda ds: days_in_month(ds),
    "month": lambda ds: F.month(ds),
    "dayofweek": lambda ds: F.dayofweek(ds),
    "day": lambda ds: F.dayofmonth(ds),
    "year": lambda ds: F.year(ds),
}


def series_window(cols: Cols = DEFAULT):
    return Window.partitionBy(cols.id).orderBy(cols.ds)


def difference(df: DataFrame, cols: Cols = DEFAULT, order: int = 1,
               keep_level: str | None = None) -> DataFrame:
    """First difference ``y - lag(y, order)`` (W10); optionally keep the level."""
    w = series_window(cols)
    out = df.withColumn(keep_level, F.col(cols.y)) if keep_level else df
    return out.withColumn(cols.y, F.col(cols.y) - F.lag(cols.y, order).over(w))


def undifference(forecasts: DataFrame, last_level: DataFrame, cols: Cols = DEFAULT,
                 value_cols: list[str] | None = None, level_col: str = "_last_level") -> DataFrame:
    """Inverse of a first difference on forecasts.

    ``level(n+k) = y(n) + sum_{j<=k} d(n+j)``: a running sum per series
    over the horizon rows, plus the last observed level.
    """
    value_cols = value_cols or [cols.y]
    w = series_window(cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = forecasts.join(last_level, cols.id, "inner")
    return j.withColumns({c: F.col(level_col) + F.sum(F.col(c)).over(w) for c in value_cols}).drop(level_col)


def blocked_window(df: DataFrame, cols: Cols, freq: str, block_size: int, halo: int,
                   columns, halo_forward: int = 0, partitions: int | None = None) -> DataFrame:
    """Evaluate look-back window columns on time blocks of every series.

    Rows are keyed by ``(id, block)`` where ``block = step_index // block_size``;
    the last ``halo`` grid steps of each block are copied into the next block
    as look-back context and dropped after evaluation. A series holding a
    third of all rows is therefore spread over ``n / block_size`` tasks
    instead of one. ``columns(w)`` returns ``{name: Column}`` built on the
    block window ``w``; every column may look back at most ``halo`` rows and
    ahead at most ``halo_forward`` rows (the first ``halo_forward`` steps of
    the next block are copied back as look-ahead context). Exact on a regular
    grid (gap-fill first). ``partitions`` fixes how many the blocks are dealt into:
    grid rows shuffle as few bytes, and partitions sized by those hold too many rows.
    """
    from seriesspark.functions.frequency import step_index

    idx = step_index(F.col(cols.ds), freq)
    # a row belongs to its own block and to every block whose context reaches it
    block = lambda i: F.floor(i / block_size)
    reached = F.sequence(block(idx - halo_forward), block(idx + halo))
    exploded = df.withColumn("_own", block(idx)).withColumn("_pblk", F.explode(reached)).withColumn("_halo", F.col("_pblk") != F.col("_own")).drop("_own")
    if partitions:
        exploded = exploded.repartition(partitions, cols.id, "_pblk")
    w = Window.partitionBy(cols.id, "_pblk").orderBy(cols.ds)
    cols_out = columns(w)
    out = exploded.select(*df.columns, "_pblk", "_halo", *[c.alias(n) for n, c in cols_out.items()])
    return out.filter(~F.col("_halo")).drop("_halo")


def _running_totals(df: DataFrame, cols: Cols, freq: str, block_size: int, partitions: int | None = None) -> DataFrame:
    """``_run_s``/``_run_n``: sum and count of non-null ``y`` up to each row, blockwise.

    Within-block running totals plus the totals of all earlier blocks of the
    series (an aggregate per block and a window over the few block rows).
    """
    from seriesspark.functions.frequency import step_index

    with_blk = df.withColumn("_pblk", F.floor(step_index(F.col(cols.ds), freq) / block_size))
    if partitions:
        with_blk = with_blk.repartition(partitions, cols.id, "_pblk")
    w = (Window.partitionBy(cols.id, "_pblk").orderBy(cols.ds)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = with_blk.select("*", F.sum(cols.y).over(w).alias("_rs"), F.count(cols.y).over(w).alias("_rc"))
    tot = with_blk.groupBy(cols.id, "_pblk").agg(F.sum(cols.y).alias("_bs"), F.count(cols.y).alias("_bc"))
    wb = Window.partitionBy(cols.id).orderBy("_pblk").rowsBetween(Window.unboundedPreceding, -1)
    prefix = tot.select(cols.id, "_pblk", F.coalesce(F.sum("_bs").over(wb), F.lit(0)).alias("_ps"),
                        F.coalesce(F.sum("_bc").over(wb), F.lit(0)).alias("_pc"))
    j = run.join(prefix, [cols.id, "_pblk"], "inner")
    return j.select(*df.columns, (F.col("_ps") + F.coalesce(F.col("_rs"), F.lit(0))).alias("_run_s"),
                    (F.col("_pc") + F.col("_rc")).alias("_run_n"))


def lag_features(df: DataFrame, lags=(), lag_transforms: dict | None = None,
                 date_features=(), differences=(), cols: Cols = DEFAULT,
                 dropna: bool = True, keep: list[str] | None = None,
                 block_size: int | None = None, freq: str | None = None, partitions: int | None = None) -> DataFrame:
    """Feature frame for a global model (F15 preprocessing, W7-W10, X7, P14).

    Order (fixed): difference the target first (if any), compute lags and
    transforms on the differenced target, add calendar features, then drop
    rows where any feature or the target is NULL.

    ``block_size`` + ``freq`` switch to the time-blocked evaluation
    (``blocked_window``): same values on a regular grid, but no series is
    confined to one task. Expanding means then come from blockwise running
    totals instead of an unbounded frame. ``partitions``: see ``blocked_window``.
    """
    if block_size:
        return _lag_features_blocked(df, lags, lag_transforms or {}, date_features, differences, cols,
                                     dropna, keep, block_size, freq, partitions)
    for d in differences:
        df = difference(df, cols, d)
    w = series_window(cols)
    feats: dict[str, Column] = {}
    for k in lags:
        feats[f"lag{k}"] = F.lag(cols.y, k).over(w)
    for k, transforms in (lag_transforms or {}).items():
        for tr in transforms:
            feats[tr.name(k)] = tr.column(cols.y, k, w)
    for name in date_features:
        feats[name] = DATE_FEATURES[name](F.col(cols.ds))
    out = df.select(*(keep or df.columns), *[c.alias(n) for n, c in feats.items()])
    if dropna:
        out = out.na.drop(subset=[cols.y, *feats])
    return out


def _lag_features_blocked(df, lags, lag_transforms, date_features, differences, cols, dropna, keep,
                          block_size, freq, partitions):
    if not freq:
        raise ValueError("block_size needs freq")
    y = cols.y
    for d in differences:
        df = blocked_window(df, cols, freq, block_size, d,
                            lambda w, d=d: {"_yd": F.col(y) - F.lag(y, d).over(w)}, partitions=partitions)
        df = df.drop(y, "_pblk").withColumnRenamed("_yd", y)
    base_cols = list(keep or df.columns)
    expanding = [k for k, trs in lag_transforms.items() if any(isinstance(t, ExpandingMean) for t in trs)]
    if expanding:
        df = _running_totals(df, cols, freq, block_size, partitions)
    halo = max([*lags, *expanding, 0,
                *[k + t.window_size - 1 for k, trs in lag_transforms.items() for t in trs
                  if not isinstance(t, ExpandingMean)]])
    names: list[str] = []

    def columns(w):
        out: dict[str, Column] = {}
        for k in lags:
            out[f"lag{k}"] = F.lag(y, k).over(w)
        for k, trs in lag_transforms.items():
            for tr in trs:
                if isinstance(tr, ExpandingMean):
                    out[tr.name(k)] = F.try_divide(F.lag("_run_s", k).over(w), F.lag("_run_n", k).over(w))
                else:
                    out[tr.name(k)] = tr.column(y, k, w)
        names.extend(out)
        return out

    feats = blocked_window(df, cols, freq, block_size, halo, columns, partitions=partitions)
    for name in date_features:
        feats = feats.withColumn(name, DATE_FEATURES[name](F.col(cols.ds)))
        names.append(name)
    out = feats.select(*base_cols, *names)
    if dropna:
        out = out.na.drop(subset=[y, *names])
    return out


def rolling_stats(df: DataFrame, windows=(144, 720), cols: Cols = DEFAULT,
                  exact_scale: int | None = None, block_size: int | None = None,
                  freq: str | None = None) -> DataFrame:
    """Rolling mean and sample std including the current row.

    Emitted only when the full window of non-null values exists. With
    ``exact_scale`` (for fixed-place data) the mean is an exact decimal sum
    divided once, so it does not depend on summation order. ``block_size`` +
    ``freq`` evaluate on time blocks with a halo (``blocked_window``).
    """
    if exact_scale is not None and not block_size:
        return _rolling_prefix(df, windows, cols, exact_scale)
    if block_size:
        stats = lambda w: _rolling_columns(w, windows, cols, exact_scale)
        out = blocked_window(df.select(cols.id, cols.ds, cols.y), cols, freq, block_size,
                             max(windows) - 1, stats)
        return out.drop("_pblk")
    return df.select(cols.id, cols.ds, cols.y,
                     *[c.alias(n) for n, c in _rolling_columns(series_window(cols), windows, cols,
                                                               exact_scale).items()])


def _rolling_prefix(df: DataFrame, windows, cols: Cols, scale: int) -> DataFrame:
    """Rolling mean/std from exact decimal prefix sums: O(n) per series.

    A sliding frame re-aggregates every frame (O(n * w)); here running sums
    of ``y`` and ``y^2`` (decimal, exact for fixed-place values below about
    1e6) are differenced against their value ``w`` rows earlier. The
    variance numerator ``n*sum(y^2) - sum(y)^2`` is exact in decimal, so
    constant windows give a standard deviation of exactly 0.
    """
    w = series_window(cols)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    yd = F.col(cols.y).cast(f"decimal(18,{scale})")
    staged = df.select(cols.id, cols.ds, cols.y, F.sum(yd).over(run).alias("_s"),
                       F.sum(yd * yd).over(run).alias("_ss"), F.count(cols.y).over(run).alias("_c"))
    out = {}
    for size in windows:
        def diff(c, zero):
            return F.col(c) - F.coalesce(F.lag(c, size).over(w), zero)
        sw = diff("_s", F.lit(0).cast(f"decimal(18,{scale})")).cast(f"decimal(17,{scale})")
        ssw = diff("_ss", F.lit(0).cast(f"decimal(18,{2 * scale})")).cast(f"decimal(27,{2 * scale})")
        cw = diff("_c", F.lit(0))
        full = cw == size
        num = ssw * cw.cast("decimal(8,0)") - sw * sw
        var = num.cast("double") / (cw * (cw - 1))
        out[f"rolling_mean_{size}"] = F.when(full, sw.cast("double") / cw)
        out[f"rolling_std_{size}"] = F.when(full, F.sqrt(F.greatest(var, F.lit(0.0))))
    return staged.select(cols.id, cols.ds, cols.y, *[c.alias(n) for n, c in out.items()])


def _rolling_columns(w, windows, cols: Cols, exact_scale: int | None) -> dict:
    out = {}
    for size in windows:
        frame = w.rowsBetween(-(size - 1), 0)
        full = F.count(F.col(cols.y)).over(frame) == size
        if exact_scale is None:
            mean = F.avg(cols.y).over(frame)
        else:
            mean = (F.sum(F.col(cols.y).cast(f"decimal(18,{exact_scale})")).over(frame).cast("double")
                    / F.count(F.col(cols.y)).over(frame))
        out[f"rolling_mean_{size}"] = F.when(full, mean)
        out[f"rolling_std_{size}"] = F.when(full, F.stddev_samp(cols.y).over(frame))
    return out


def window_label(size: int, steps_per_day: int) -> Column:
    """Label of a window size in days, e.g. ``144`` 10-minute steps -> ``1 days``."""
    return F.format_string("%d days", F.lit(size // steps_per_day))


def join_future_exog(horizon: DataFrame, exog: DataFrame, cols: Cols = DEFAULT) -> DataFrame:
    """Attach future exogenous values to horizon rows.

    Left join on ``(id, ds)``; a ``_missing_exog`` flag marks horizon rows
    without exogenous values so callers can assert complete cover.
    """
    ex_cols = [c for c in exog.columns if c not in (cols.id, cols.ds)]
    j = horizon.join(exog, [cols.id, cols.ds], "left")
    miss = F.lit(False)
    for c in ex_cols:
        miss = miss | F.col(c).isNull()
    return j.withColumn("_missing_exog", miss)
