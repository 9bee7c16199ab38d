"""Exponential smoothing models as Spark expressions.

A series is reduced to one ordered array per row; a model is a fold over that
array (``aggregate``), evaluated for every parameter set of a fixed grid. The 125
sets of Holt-Winters are folded together over Arrow batches of series. The set with
the smallest one-step squared error wins, ties go to the earlier set. Fitted values
are the trajectory of the winning fold, and cross validation takes its state at each
cutoff.

* Holt-Winters (F3): additive trend and season; level0 = mean of cycle 1, trend0 =
  (mean of cycle 2 - mean of cycle 1) / m, season0 = cycle 1 - level0; alpha, beta,
  gamma from HW_GRID. Series under two cycles, or m < 2, repeat their last value.
* ADIDA (F6): A = max(1, round(mean interval between demands)), buckets of A rows
  counted back from the end, simple exponential smoothing of the bucket sums with
  alpha from ADIDA_ALPHAS, forecast = level / A; without any demand it is 0.
* Fitted values (F8): the forecast of a row from the rows before it. Holt-Winters: level +
  trend + season of its step, or the value before; ADIDA: the level before the row's
  bucket over A, NULL in the first bucket and before it, 0 without demand.
* Intervals (F7): sigma = root of the mean squared one-step error of the fitted values;
  Holt-Winters grows by sqrt(1 + sum of c_j^2, j < k) with c_j = alpha (1 + j beta) +
  gamma (1 - alpha) at full cycles; a repeated last value by sqrt(k); ADIDA by
  sqrt(1 + (ceil(k / A) - 1) alpha^2).
* Cross validation (W14) without refit: parameters (and A) of the earliest cutoff's
  history; later cutoffs continue its state over the new rows. ADIDA's buckets go on from
  the earliest cutoff; rows short of a bucket wait.

NULL targets count as 0. The array of a series is its length times 8 bytes.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesspark.functions.contracts import DEFAULT, Cols
from seriesspark.operators.forecast import normal_quantile
from seriesspark.operators.grid import horizon_grid

# Smoothing parameter grids.
HW_GRID = (0.1, 0.3, 0.5, 0.7, 0.9)
ADIDA_ALPHAS = (0.10, 0.15, 0.20, 0.25, 0.30)
HW_FIT = "struct<sse: double, i: int, l: double, b: double, s: array<double>>"
HW_ARROW = pa.struct([("sse", pa.float64()), ("i", pa.int32()), ("l", pa.float64()), ("b", pa.float64()), ("s", pa.list_(pa.float64()))])
CHUNK = 256   # values of a trajectory that are appended one by one


def _ordered(df: DataFrame, cols: Cols) -> DataFrame:
    """One row per series: ``_y`` in time order, its stamps ``_t`` and the last one."""
    point = F.struct(F.col(cols.ds).alias("t"), F.coalesce(F.col(cols.y).cast("double"), F.lit(0.0)).alias("v"))
    return df.groupBy(cols.id).agg(F.sort_array(F.collect_list(point)).alias("_s")) \
        .select(cols.id, F.col("_s.v").alias("_y"), F.col("_s.t").alias("_t"), F.element_at("_s", -1)["t"].alias("_last_ds"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _grid(values: Sequence[float], names: Sequence[str]) -> Column:
    """All combinations of ``values`` for ``names``, the last name fastest, as structs."""
    sets = [()]
    for _ in names:
        sets = [(*s, v) for s in sets for v in values]
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, s)]) for s in sets])


def _best(params: Column, fit) -> Column:
    """The smallest of the fits ``struct(sse, place, ...)``."""
    return F.array_min(F.transform(params, lambda p, i: fit(p, i)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def trajectory(values: Column, start: Column, step, emit) -> Column:
    """``emit(state, value)`` for every value, the state being that before the value.

    Emitted values are appended within runs of CHUNK, the runs to a list of runs: linear
    in the number of values, up to the square of the number of runs.
    """
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / CHUNK).cast("int") - 1, F.lit(0))), lambda k: F.slice(values, k * CHUNK + 1, CHUNK))
    one = lambda a, v: F.struct(step(a["s"], v).alias("s"), F.concat(a["out"], F.array(emit(a["s"], v))).alias("out"))

    def run(a: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(a["s"].alias("s"), F.array().cast("array<double>").alias("out")), one)
        return _let(inner, lambda r: F.struct(r["s"].alias("s"), F.concat(a["runs"], F.array(r["out"])).alias("runs")))
    return F.aggregate(runs, F.struct(start.alias("s"), F.array().cast("array<array<double>>").alias("runs")), run, lambda a: F.flatten(a["runs"]))


# ------------------------------------------------------------ Holt-Winters

def _hw_step(p: Column, m: int):
    """The state ``l, b, s`` after a value; ``s`` begins with the season of the next step."""
    def step(a: Column, v: Column) -> Column:
        level = p["a"] * (v - a["s"][0]) + (1 - p["a"]) * (a["l"] + a["b"])
        return _let(level, lambda l: F.struct(l.alias("l"), (p["t"] * (l - a["l"]) + (1 - p["t"]) * a["b"]).alias("b"),
                                              F.concat(F.slice(a["s"], 2, m - 1), F.array(p["g"] * (v - l) + (1 - p["g"]) * a["s"][0])).alias("s")))
    return step


def _hw_next(a: Column, _v: Column | None = None) -> Column:
    return a["l"] + a["b"] + a["s"][0]


BLOCK = 128   # series that one step of the fit moves at once


def _hw_grid_fit(m: int):
    """The best fit (``sse, i, l, b, s``) of every series of a batch over all of HW_GRID; NULL under two cycles.

    The recursion is that of ``_hw_step``; a step moves all parameter sets of up to
    BLOCK series of one length, so memory is BLOCK times the sets times the season.
    """
    a, t, g = (np.array([p[k] for p in itertools.product(HW_GRID, repeat=3)]) for k in range(3))

    def block(y: np.ndarray) -> list[dict]:
        rows, n = y.shape
        mean1, mean2 = (sum((y[:, k + j] for j in range(m)), np.zeros(rows)) / m for k in (0, m))
        wide = lambda v: np.repeat(v[:, None], len(a), axis=1)
        level, trend, sse = wide(mean1), wide((mean2 - mean1) / m), np.zeros((rows, len(a)))
        season = [wide(y[:, j] - mean1) for j in range(m)]
        for k in range(n):
            v, s = y[:, k:k + 1], season[k % m]
            ahead = level + trend
            error = v - (ahead + s)
            sse += error * error
            new = a * (v - s) + (1 - a) * ahead
            trend = t * (new - level) + (1 - t) * trend
            season[k % m], level = g * (v - new) + (1 - g) * s, new
        # the smallest error, the earlier set of equal ones, NaN last
        best = np.lexsort((sse, np.isnan(sse)), axis=1)[:, 0]
        at = lambda x: x[np.arange(rows), best].tolist()
        state = zip(at(sse), best.tolist(), at(level), at(trend), zip(*[at(season[(n + j) % m]) for j in range(m)]))
        return [{"sse": e, "i": i, "l": l, "b": b, "s": list(s)} for e, i, l, b, s in state]

    @F.arrow_udf(HW_FIT)
    def fit(values: pa.Array) -> pa.Array:
        found: list[dict | None] = [None] * len(values)
        sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for n in np.unique(sizes[sizes >= 2 * m]):
            same = np.flatnonzero(sizes == n)
            with np.errstate(over="ignore", invalid="ignore"):
                for k in range(0, len(same), BLOCK):
                    part = same[k:k + BLOCK]
                    y = values.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), n)
                    for row, one in zip(part, block(y)):
                        found[row] = one
        return pa.array(found, HW_ARROW)
    return fit


def _hw_fit(s: DataFrame, m: int, y: Column) -> DataFrame:
    """``s`` with ``_start``, the best fit ``_b`` (``sse, i, l, b, s``) and its parameters ``_p``; NULL under two cycles of ``y``."""
    mean1, mean2 = _sum(F.slice(y, 1, m)) / m, _sum(F.slice(y, m + 1, m)) / m
    start = F.struct(mean1.alias("l"), ((mean2 - mean1) / m).alias("b"), F.transform(F.slice(y, 1, m), lambda v: v - mean1).alias("s"))
    whole = F.size(y) >= 2 * m if m >= 2 else F.lit(False)
    s = s.withColumn("_start", F.when(whole, start)).withColumn("_b", F.when(whole, _hw_grid_fit(m)(y)) if m >= 2 else F.lit(None).cast(HW_FIT))
    return s.withColumn("_p", F.get(_grid(HW_GRID, "atg"), F.col("_b.i")))


def _hw_ahead(state: Column, h: int, m: int) -> Column:
    # the season queue begins with the first forecast's season
    return F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: state["l"] + k * state["b"] + state["s"][(k - 1) % m])


def holt_winters(df: DataFrame, h: int, freq: str, season_length: int, cols: Cols = DEFAULT, level: list[int] | None = None) -> DataFrame:
    """Long forecasts ``(id, ds, model, yhat, lo-<l>, hi-<l>)`` of additive Holt-Winters."""
    m, y = season_length, F.col("_y")
    s = _hw_fit(_ordered(df, cols), m, y)
    s = s.withColumn("_f", F.when(F.col("_b").isNotNull(), _hw_ahead(F.col("_b"), h, m)).otherwise(F.array_repeat(F.element_at(y, -1), h)))
    if level:
        p, steps = F.col("_p"), F.sequence(F.lit(1), F.lit(h))
        part = lambda j: p["a"] * (1 + j * p["t"]) + F.when(j % m == 0, p["g"] * (1 - p["a"])).otherwise(0.0)
        grown = lambda k: 1 + _sum(F.transform(F.filter(steps, lambda j: j < k), lambda j: part(j) * part(j)))
        jumps = F.transform(F.slice(y, 2, F.size(y)), lambda v, i: (v - y[i]) * (v - y[i]))
        naive = F.when(F.size(y) > 1, _sum(jumps) / (F.size(y) - 1))
        s = s.withColumn("_sd", F.when(p.isNotNull(), F.transform(steps, lambda k: F.sqrt(F.col("_b.sse") / F.size(y) * grown(k))))
                         .otherwise(F.transform(steps, lambda k: F.sqrt(naive * k))))
    return _rows(s, h, freq, "HoltWinters", cols, level)


def holt_winters_fitted(df: DataFrame, season_length: int, cols: Cols = DEFAULT) -> DataFrame:
    """``(id, ds, y, HoltWinters)``: one-step forecasts inside the history (F8)."""
    s = _hw_fit(_ordered(df, cols), season_length, F.col("_y"))
    path = trajectory(F.col("_y"), F.col("_start"), lambda a, v: _hw_step(F.col("_p"), season_length)(a, v), _hw_next)
    before = F.transform("_y", lambda v, i: F.get("_y", i - 1))
    return _fitted_rows(s.withColumn("_f", F.when(F.col("_p").isNotNull(), path).otherwise(before)), "HoltWinters", cols)


# ------------------------------------------------------------ ADIDA

def _adida_fit(s: DataFrame, y: Column) -> DataFrame:
    """``s`` with ``_a`` (rows of a bucket), the bucket sums ``_k`` and the best fit ``_b`` (``sse, i, l``) of ``y``."""
    demand = F.filter(F.transform(y, lambda v, i: F.when(v != 0, i + 1)), lambda p: p.isNotNull())
    s = s.withColumn("_d", demand)
    s = s.withColumn("_a", F.greatest(F.lit(1), F.floor(F.try_divide(F.get("_d", F.size("_d") - 1), F.size("_d")) + 0.5).cast("int")))
    n, a = F.size(y), F.col("_a")
    s = s.withColumn("_k", F.when((F.size("_d") > 0) & (n >= a), _buckets(y, n % a, F.floor(n / a).cast("int"), a)))

    def fit(p: Column, i: Column) -> Column:
        start = F.struct(F.col("_k")[0].alias("l"), F.lit(0.0).alias("sse"))
        return F.aggregate(F.slice("_k", 2, F.greatest(F.size("_k") - 1, F.lit(0))), start, lambda acc, v: F.struct(
            (p["a"] * v + (1 - p["a"]) * acc["l"]).alias("l"), (acc["sse"] + (v - acc["l"]) * (v - acc["l"])).alias("sse")),
            lambda acc: F.struct(acc["sse"].alias("sse"), i.alias("i"), acc["l"].alias("l")))

    grid = _grid(ADIDA_ALPHAS, "a")
    s = s.withColumn("_b", F.when(F.col("_k").isNotNull(), _best(grid, fit)))
    return s.withColumn("_p", F.get(grid, F.col("_b.i"))["a"])


def _buckets(y: Column, skip: Column, count: Column, a: Column) -> Column:
    """Sums of ``count`` runs of ``a`` values after the first ``skip``; empty for none."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: _sum(F.slice(y, skip + k * a + 1, a)))) \
        .otherwise(F.array().cast("array<double>"))


def _ses(p: Column):
    return lambda l, v: p * v + (1 - p) * l


def _adida_path(y: Column) -> Column:
    """Fitted values of all rows."""
    n, a = F.size(y), F.col("_a")
    levels = trajectory(F.slice("_k", 2, F.greatest(F.size("_k") - 1, F.lit(0))), F.col("_k")[0], _ses(F.col("_p")), lambda l, v: l)
    bucket = lambda i: F.floor((i - n % a) / a).cast("int")
    return _let(levels, lambda path: F.transform(y, lambda v, i: F.when(F.size("_d") == 0, F.lit(0.0)).when((i >= n % a) & (bucket(i) > 0), F.get(path, bucket(i) - 1) / a)))


def adida(df: DataFrame, h: int, freq: str, cols: Cols = DEFAULT, level: list[int] | None = None) -> DataFrame:
    """Long forecasts ``(id, ds, model, yhat, lo-<l>, hi-<l>)`` of ADIDA."""
    s = _adida_fit(_ordered(df, cols), F.col("_y"))
    s = s.withColumn("_f", F.array_repeat(F.coalesce(F.col("_b.l") / F.col("_a"), F.lit(0.0)), h))
    if level:
        errors = _let(_adida_path(F.col("_y")), lambda path: F.filter(F.zip_with("_y", path, lambda v, f: v - f), lambda e: e.isNotNull()))
        s = s.withColumn("_s2", _let(errors, lambda e: F.when(F.size(e) > 0, _sum(F.transform(e, lambda x: x * x)) / F.size(e))))
        s = s.withColumn("_sd", F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: F.sqrt(
            F.col("_s2") * (1 + (F.ceil(k / F.col("_a")) - 1) * F.coalesce(F.col("_p") * F.col("_p"), F.lit(0.0))))))
    return _rows(s, h, freq, "ADIDA", cols, level)


def adida_fitted(df: DataFrame, cols: Cols = DEFAULT) -> DataFrame:
    """``(id, ds, y, ADIDA)``: one-step forecasts inside the history (F8)."""
    s = _adida_fit(_ordered(df, cols), F.col("_y"))
    return _fitted_rows(s.withColumn("_f", _adida_path(F.col("_y"))), "ADIDA", cols)


# ------------------------------------------------------------ cross validation

def smoothing_cv(df: DataFrame, h: int, n_windows: int, model: str, step: int | None = None, season_length: int = 1, cols: Cols = DEFAULT) -> DataFrame:
    """``(id, ds, cutoff, y, <model>)`` of Holt-Winters or ADIDA at each cutoff, without refit.

    The model is fitted on the rows up to the earliest cutoff; one fold over the rest
    carries its state on, and the horizon is computed from the state at each cutoff.
    Series too short for the earliest cutoff are left out (``short_series`` lists them).
    """
    step, m, y = h if step is None else step, season_length, F.col("_y")
    s = _ordered(df, cols).where(F.size(y) - h - step * (n_windows - 1) >= 1)
    c0 = F.size(y) - h - step * (n_windows - 1)
    s = s.withColumn("_c", c0).withColumn("_h", F.slice(y, 1, F.col("_c")))
    windows = F.sequence(F.lit(1), F.lit(n_windows - 1)) if n_windows > 1 else F.array().cast("array<int>")
    if model == "HoltWinters":
        s = _hw_fit(s, m, F.col("_h"))
        move = lambda a, i: F.aggregate(F.slice(y, F.col("_c") + (i - 1) * step + 1, step), a, _hw_step(F.col("_p"), m))
        state = lambda a: F.struct(a["l"].alias("l"), a["b"].alias("b"), a["s"].alias("s"))
        first, repeat = state(F.col("_b")), lambda c: F.array_repeat(y[c - 1], h)
        ahead = lambda a, c: F.when(a.isNotNull(), _hw_ahead(a, h, m)).otherwise(repeat(c))
        first = F.when(F.col("_b").isNotNull(), first)
    elif model == "ADIDA":
        s = _adida_fit(s, F.col("_h"))
        a_ = F.col("_a")
        done = lambda i: F.floor(i * step / a_).cast("int")  # noqa: E731  buckets complete at cutoff i since the first
        fresh = lambda i: _buckets(F.slice(y, F.col("_c") + 1, F.size(y)), done(i - 1) * a_, done(i) - done(i - 1), a_)
        move = lambda a, i: F.aggregate(fresh(i), a, _ses(F.col("_p")))
        first, ahead = F.col("_b.l"), lambda a, c: F.array_repeat(F.coalesce(a / a_, F.lit(0.0)), h)
    else:
        raise ValueError(model)
    # the states at all cutoffs, each from the one before
    states = F.aggregate(windows, F.array(first), lambda all_, i: F.concat(all_, F.array(move(F.element_at(all_, -1), i))))
    s = s.withColumn("_states", states)
    forecasts = F.transform("_states", lambda a, i: F.struct((F.col("_c") + i * step).alias("c"), ahead(a, F.col("_c") + i * step).alias("f")))
    rows = s.select(cols.id, "_t", "_y", F.explode(forecasts).alias("_w")).select("*", F.posexplode("_w.f").alias("_k", "_yhat"))
    at = F.col("_w.c") + F.col("_k")
    return rows.select(cols.id, F.get("_t", at).alias(cols.ds), F.get("_t", F.col("_w.c") - 1).alias("cutoff"), F.get("_y", at).alias(cols.y), F.col("_yhat").alias(model))


def _fitted_rows(s: DataFrame, model: str, cols: Cols) -> DataFrame:
    rows = s.select(cols.id, F.explode(F.arrays_zip("_t", "_y", "_f")).alias("_e"))
    return rows.select(cols.id, F.col("_e._t").alias(cols.ds), F.col("_e._y").alias(cols.y), F.col("_e._f").alias(model))


def _rows(fitted: DataFrame, h: int, freq: str, model: str, cols: Cols, level: list[int] | None = None) -> DataFrame:
    g = horizon_grid(fitted.select(cols.id, "_last_ds", "_f", *(["_sd"] if level else [])), h, freq, cols)
    yhat, spread = F.col("_f")[F.col("k") - 1], [] if not level else F.col("_sd")[F.col("k") - 1]
    bounds = [(yhat + side * F.lit(normal_quantile(lv)) * spread).alias(f"{name}-{lv}") for lv in level or [] for name, side in (("lo", -1), ("hi", 1))]
    return g.select(cols.id, cols.ds, F.lit(model).alias("model"), yhat.alias("yhat"), *bounds)
