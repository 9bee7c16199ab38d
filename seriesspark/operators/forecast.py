"""Closed-form forecasters over many series.

History is shuffled once by series key: a single window pass computes the
in-sample residuals, then an aggregate on the same partitioning reduces every
series to one summary row (last value, last season, residual variance), and
the horizon is generated from that row. No join, no second shuffle.

Definitions fixed here:

* Naive: ``yhat(n+k) = y(n)``.
* SeasonalNaive: ``yhat(n+k) = y(n - m + 1 + ((k-1) % m))``; series shorter
  than ``m`` get no forecast.
* Intervals (F7): ``sigma^2`` = mean squared in-sample residual;
  naive ``sigma*sqrt(k)``, seasonal naive ``sigma*sqrt(floor((k-1)/m)+1)``,
  times the normal quantile of the level (1.2815515655446004 for 80).
* Quantile forecast (F10): residual of the k-step base forecast at every
  legal origin, exact linear-interpolation quantiles per series and step
  (``quantiles.exact_quantiles``, no group buffered whole); ``predictions``
  is the 0.5 quantile.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesspark.functions.contracts import DEFAULT, Cols
from seriesspark.operators.grid import horizon_grid

CLOSED_FORM = ("Naive", "SeasonalNaive")


def normal_quantile(level: float) -> float:
    """Two-sided normal quantile for a level in percent (80 -> 1.28155...)."""
    return NormalDist().inv_cdf(0.5 + level / 200.0)


def _summary(df: DataFrame, cols: Cols, season_length: int, block_size: int | None = None,
             freq: str | None = None) -> DataFrame:
    """One row per series: last stamp/value, residual variances, last season.

    With ``block_size`` (regular grid) the residuals and the "last m rows"
    flag come from a time-blocked window with an ``m``-step halo both ways
    (the flag is ``lead(ds, m) IS NULL``), so a hot series is spread over
    blocks and the per-series reduction is a partially aggregated group-by.
    """
    y = F.col(cols.y)
    m = season_length
    if block_size:
        from seriesspark.operators.features import blocked_window

        def cols_fn(w):
            return {"_e1": y - F.lag(y, 1).over(w), "_em": y - F.lag(y, m).over(w),
                    "_in_season": F.lead(cols.ds, m).over(w).isNull()}
        staged = blocked_window(df.select(cols.id, cols.ds, cols.y), cols, freq, block_size,
                                max(m, 1), cols_fn, halo_forward=m)
    else:
        w = Window.partitionBy(cols.id).orderBy(cols.ds)
        n = F.count(F.lit(1)).over(Window.partitionBy(cols.id))
        staged = df.select(
            cols.id, cols.ds, cols.y,
            (y - F.lag(y, 1).over(w)).alias("_e1"),
            (y - F.lag(y, m).over(w)).alias("_em"),
            (F.row_number().over(w) > n - m).alias("_in_season"))
    return staged.groupBy(cols.id).agg(
        F.max(cols.ds).alias("_last_ds"),
        F.count(F.lit(1)).alias("_n"),
        F.max_by(cols.y, cols.ds).alias("_last_y"),
        F.avg(F.col("_e1") * F.col("_e1")).alias("_s2_naive"),
        F.avg(F.col("_em") * F.col("_em")).alias("_s2_snaive"),
        F.sort_array(F.collect_list(F.when(F.col("_in_season"), F.struct(cols.ds, cols.y))))
        .alias("_season"))


def _model_columns(model: str, m: int, y_col: str) -> tuple[Column, Column]:
    k = F.col("k")
    if model == "Naive":
        return F.col("_last_y"), F.sqrt(F.col("_s2_naive")) * F.sqrt(k)
    if model == "SeasonalNaive":
        point = F.when(F.col("_n") >= m,
                       F.element_at(F.col("_season"), ((k - 1) % m + 1).cast("int")).getField(y_col))
        return point, F.sqrt(F.col("_s2_snaive")) * F.sqrt(F.floor((k - 1) / m) + 1)
    raise ValueError(f"{model} is not a closed-form model; use seriesspark.operators.solvers")


def closed_form_forecast(df: DataFrame, h: int, freq: str, models=CLOSED_FORM,
                         season_length: int = 1, level: list[int] | None = None,
                         cols: Cols = DEFAULT, block_size: int | None = None) -> DataFrame:
    """Wide forecast frame ``(id, ds, <model>, <model>-lo-<l>, <model>-hi-<l>)``.

    The season array holds the last ``m`` values only, so the summary row of
    a series is bounded by ``m`` regardless of its length. ``block_size``
    selects the time-blocked summary for panels with very long series.
    """
    summary = _summary(df, cols, season_length, block_size, freq)
    grid = horizon_grid(summary, h, freq, cols)
    proj = [F.col(cols.id), F.col(cols.ds)]
    for model in models:
        point, spread = _model_columns(model, season_length, cols.y)
        proj.append(point.alias(model))
        for lv in level or []:
            z = F.lit(normal_quantile(lv))
            proj.append((point - z * spread).alias(f"{model}-lo-{lv}"))
            proj.append((point + z * spread).alias(f"{model}-hi-{lv}"))
    return grid.select(*proj)


def fitted_values(df: DataFrame, season_length: int, models=CLOSED_FORM,
                  cols: Cols = DEFAULT, block_size: int | None = None,
                  freq: str | None = None) -> DataFrame:
    """In-sample one-step fitted values (F8): naive ``lag(y,1)``, seasonal ``lag(y,m)``.

    ``block_size`` + ``freq`` evaluate the lags on time blocks with an
    ``m``-step halo.
    """
    lags = {"Naive": 1, "SeasonalNaive": season_length}

    def fitted(w):
        return {m: F.lag(cols.y, lags[m]).over(w) for m in models}

    if block_size:
        from seriesspark.operators.features import blocked_window
        return blocked_window(df.select(cols.id, cols.ds, cols.y), cols, freq, block_size,
                              max(lags[m] for m in models), fitted).drop("_pblk")
    w = Window.partitionBy(cols.id).orderBy(cols.ds)
    return df.select(cols.id, cols.ds, cols.y, *[c.alias(n) for n, c in fitted(w).items()])


def to_long(wide: DataFrame, models, cols: Cols = DEFAULT, value_name: str = "yhat") -> DataFrame:
    """Wide model columns to ``(id, ds, model, yhat)``."""
    keep = [c for c in wide.columns if c not in models and "-lo-" not in c and "-hi-" not in c]
    return wide.unpivot(keep, list(models), "model", value_name)


def to_wide(long: DataFrame, models, cols: Cols = DEFAULT, value_col: str = "yhat") -> DataFrame:
    """``(id, ds, model, yhat)`` to one column per model (D24, F9 output).

    The model names are passed explicitly, so the pivot needs no extra job to
    discover them.
    """
    return long.groupBy(cols.id, cols.ds).pivot("model", list(models)).agg(F.first(value_col))


def forecast_models(df: DataFrame, models: dict, cols: Cols = DEFAULT) -> DataFrame:
    """One wide frame from a dict of models (U3, F9): ``(id, ds, <model>...)``.

    Each value is a function from the history to long forecasts ``(id, ds, ...,
    yhat)``; the key names its column, so closed forms, smoothing models, solvers
    and a caller's own function mix freely.
    """
    long = None
    for name, forecast in models.items():
        part = forecast(df).select(cols.id, cols.ds, F.lit(name).alias("model"), F.col("yhat").cast("double").alias("yhat"))
        long = part if long is None else long.unionByName(part)
    return to_wide(long, list(models), cols)


def quantile_forecast(df: DataFrame, h: int, freq: str, quantiles=(0.1, 0.5, 0.9),
                      base: str = "Naive", season_length: int = 1,
                      cols: Cols = DEFAULT, block_size: int | None = None) -> DataFrame:
    """Probabilistic forecast from empirical k-step residual quantiles.

    Output ``(id, ds, predictions, "<q>"...)`` with quantile columns named by
    their level as in the reference (``0.1``, ``0.5``, ``0.9``). With
    ``block_size`` (regular grid) the residual window runs on time blocks
    with halos (``m`` back, ``max(h, m)`` ahead).
    """
    y = F.col(cols.y)
    m = season_length

    def residuals(w):
        out = {}
        for k in range(1, h + 1):
            origin = y if base == "Naive" else F.lag(y, m - 1 - ((k - 1) % m)).over(w)
            out[f"_r{k}"] = F.lead(y, k).over(w) - origin
        out["_in_season"] = F.lead(cols.ds, m).over(w).isNull()
        return out

    if block_size:
        from seriesspark.operators.features import blocked_window
        staged = blocked_window(df.select(cols.id, cols.ds, cols.y), cols, freq, block_size, max(m, 1),
                                residuals, halo_forward=max(h, m))
    else:
        w = Window.partitionBy(cols.id).orderBy(cols.ds)
        staged = df.select(cols.id, cols.ds, cols.y, *[c.alias(n) for n, c in residuals(w).items()])
    from seriesspark.operators.quantiles import exact_quantiles

    summary = staged.groupBy(cols.id).agg(
        F.max(cols.ds).alias("_last_ds"), F.count(F.lit(1)).alias("_n"),
        F.max_by(cols.y, cols.ds).alias("_last_y"),
        F.sort_array(F.collect_list(F.when(F.col("_in_season"), F.struct(cols.ds, cols.y)))).alias("_season"))
    stack = ", ".join(f"{k}, `_r{k}`" for k in range(1, h + 1))
    long = staged.selectExpr(f"`{cols.id}`", f"stack({h}, {stack}) AS (k, _r)")
    qv = (exact_quantiles(long, [cols.id, "k"], "_r", list(quantiles))
          .groupBy(cols.id, "k").agg(F.sort_array(F.collect_list(F.struct("q", "quantile"))).alias("_q")))
    grid = horizon_grid(summary, h, freq, cols).join(qv, [cols.id, "k"], "left")
    point, _ = _model_columns(base, m, cols.y)
    out = grid.select(cols.id, cols.ds, *[
        (point + F.element_at(F.col("_q"), i + 1).getField("quantile")).alias(str(q))
        for i, q in enumerate(quantiles)])
    mid = str(0.5) if 0.5 in quantiles else str(quantiles[len(quantiles) // 2])
    return out.withColumn("predictions", F.col(f"`{mid}`"))


def short_series(df: DataFrame, h: int, n_windows: int, step: int | None = None, cols: Cols = DEFAULT) -> DataFrame:
    """``(id, n_rows, needed)`` of the series that cross validation leaves out: fewer rows than its earliest cutoff needs."""
    needed = h + (h if step is None else step) * (n_windows - 1) + 1
    return df.groupBy(cols.id).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") < needed) \
        .withColumn("needed", F.lit(needed))


def with_cutoffs(ranked: DataFrame, h: int, n_windows: int, step: int) -> DataFrame:
    """The test rows of all windows, each with ``_win`` and its step ``k`` after the cutoff, from ``_rn`` and ``_n``.

    Cutoff ``i`` lies after row ``_n - h - step * (n_windows - 1 - i)``; a row occurs once per
    window whose horizon holds it (once, if the step is the horizon).
    """
    off = F.col("_rn") - (F.col("_n") - h - step * (n_windows - 1))
    lo = F.greatest(F.ceil((off - h) / step), F.lit(0)).cast("int")
    hi = F.least(F.floor((off - 1) / step), F.lit(n_windows - 1)).cast("int")
    tests = ranked.where((F.col("_n") - h - step * (n_windows - 1) >= 1) & (off >= 1)).where(lo <= hi)
    return tests.withColumn("_win", F.explode(F.sequence(lo, hi))).withColumn("k", (off - F.col("_win") * step).cast("int"))


def positions(df: DataFrame, cols: Cols, freq: str | None = None, block_size: int | None = None) -> DataFrame:
    """``id, ds, y, _rn, _n``: place and length in the series; from the grid with ``block_size``, so that no series is one task."""
    if block_size:
        from seriesspark.functions.frequency import step_index
        idx = step_index(F.col(cols.ds), freq)
        span = df.groupBy(cols.id).agg(F.min(idx).alias("_lo"), F.count(F.lit(1)).alias("_n"))
        return df.select(cols.id, cols.ds, cols.y).join(span, cols.id, "inner") \
            .select(cols.id, cols.ds, cols.y, (idx - F.col("_lo") + 1).alias("_rn"), "_n")
    n = F.count(F.lit(1)).over(Window.partitionBy(cols.id))
    return df.select(cols.id, cols.ds, cols.y, F.row_number().over(Window.partitionBy(cols.id).orderBy(cols.ds)).alias("_rn"), n.alias("_n"))


def cross_validation(df: DataFrame, h: int, n_windows: int, freq: str, step: int | None = None,
                     models=CLOSED_FORM, season_length: int = 1, cols: Cols = DEFAULT,
                     block_size: int | None = None) -> DataFrame:
    """Rolling-origin cross validation without refit (W14), as one job.

    Cutoffs ``c_i = n - h - step*(n_windows-1-i)``. A closed form's forecast of a test row
    ``k`` steps after a cutoff is a value of the history at a fixed distance (``k`` for
    naive, the next multiple of the season for seasonal naive), so one window pass
    reads it by lags and no history is copied. Output ``(id, ds, cutoff, y, <model>...)``.
    Series whose first cutoff precedes row 1 are left out (``short_series`` lists them). With
    ``block_size`` (regular grid) positions come from the grid index and one aggregate
    per series, and the lags from time blocks with a halo.
    """
    step, m = h if step is None else step, season_length
    cycles = -(-h // m)

    def lags(w):
        return {**{f"_y{k}": F.lag(cols.y, k).over(w) for k in range(1, h + 1)}, **{f"_c{k}": F.lag(cols.ds, k).over(w) for k in range(1, h + 1)},
                **{f"_s{i}": F.lag(cols.y, i * m).over(w) for i in range(1, cycles + 1)}}

    if block_size:
        from seriesspark.operators.features import blocked_window
        staged = blocked_window(positions(df, cols, freq, block_size), cols, freq, block_size, max(h, cycles * m), lags)
    else:
        staged = positions(df, cols).select("*", *[c.alias(n) for n, c in lags(Window.partitionBy(cols.id).orderBy(cols.ds)).items()])
    tests = with_cutoffs(staged, h, n_windows, step)
    pick = lambda prefix, size, place: F.array(*[F.col(f"{prefix}{i}") for i in range(1, size + 1)])[place - 1]
    values = {"Naive": pick("_y", h, F.col("k")), "SeasonalNaive": pick("_s", cycles, F.ceil(F.col("k") / m).cast("int"))}
    return tests.select(cols.id, cols.ds, pick("_c", h, F.col("k")).alias("cutoff"), cols.y, *[values[name].alias(name) for name in models])
