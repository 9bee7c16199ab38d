"""Series analysis: decomposition, autocorrelation, correlation, profiles
(W16, D21-D27, D6, D7).

Every operator is a window pass and/or an aggregate keyed by series; the
correlation operators multiply tiles of series over runs of stamps, never all
pairs of series at a timestamp.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesspark.functions.contracts import DEFAULT, Cols
from seriesspark.operators.arima import let
from seriesspark.session import cut_lineage


# ------------------------------------------------------------ decomposition

def seasonal_decompose(df: DataFrame, period: int, cols: Cols = DEFAULT,
                       block_size: int | None = None, freq: str | None = None, exact_scale: int | None = None) -> DataFrame:
    """Additive decomposition with a centred moving average.

    trend (m even) = (0.5*y[t-m/2] + y[t-m/2+1] + ... + y[t+m/2-1] + 0.5*y[t+m/2]) / m,
    plain centred mean for odd m, NULL where the window is incomplete;
    seasonal = mean of (y - trend) by phase ``(rn-1) % m``, centred to zero
    over the m phases; resid = y - trend - seasonal. Series shorter than 2m
    are excluded. Phase means are an aggregate keyed by (series, phase), so
    a long series spreads over m groups. With ``block_size`` + ``freq``
    (regular grid) the trend window runs on time blocks with an ``m/2`` halo
    both ways, and position/length come from the grid index and one
    aggregate per series instead of a whole-series window. ``exact_scale`` (for
    fixed-place data) sums the trend window in decimals, so the trend does not
    depend on summation order.
    """
    m = period
    y = F.col(cols.y)
    half = m // 2

    def trend_cols(w):
        full = w.rowsBetween(-half, half)
        total = F.sum(y).over(full) if exact_scale is None else F.sum(y.cast(f"decimal(18,{exact_scale})")).over(full).cast("double")
        if m % 2 == 0:
            trend = (total - 0.5 * F.lag(y, half).over(w) - 0.5 * F.lead(y, half).over(w)) / m
        else:
            trend = total / m
        return {"trend": F.when(F.count(y).over(full) == (2 * half + 1), trend)}

    if block_size:
        from seriesspark.functions.frequency import step_index
        from seriesspark.operators.features import blocked_window

        idx = step_index(F.col(cols.ds), freq)
        span = df.groupBy(cols.id).agg(F.min(idx).alias("_lo"), F.count(F.lit(1)).alias("_n"))
        tr = blocked_window(df.select(cols.id, cols.ds, cols.y), cols, freq, block_size, half, trend_cols,
                            halo_forward=half).drop("_pblk")
        staged = (tr.join(span, cols.id, "inner").filter(F.col("_n") >= 2 * m)
                  .select(cols.id, cols.ds, cols.y, ((idx - F.col("_lo")) % m).cast("int").alias("phase"), "trend"))
    else:
        w = Window.partitionBy(cols.id).orderBy(cols.ds)
        n = F.count(F.lit(1)).over(Window.partitionBy(cols.id))
        staged = (df.select(cols.id, cols.ds, cols.y, n.alias("_n"),
                            ((F.row_number().over(w) - 1) % m).alias("phase"), trend_cols(w)["trend"].alias("trend"))
                  .filter(F.col("_n") >= 2 * m).drop("_n"))
    phase = (staged.groupBy(cols.id, "phase").agg(F.avg(y - F.col("trend")).alias("_s"))
             .withColumn("_s", F.col("_s") - F.avg("_s").over(Window.partitionBy(cols.id))))
    return (staged.join(phase, [cols.id, "phase"], "inner")
            .select(cols.id, cols.ds, cols.y, "trend", F.col("_s").alias("seasonal"),
                    (y - F.col("trend") - F.col("_s")).alias("resid")))


# ------------------------------------------------------------ autocorrelation

def acf(df: DataFrame, nlags: int, cols: Cols = DEFAULT, block_size: int | None = None,
        freq: str | None = None) -> DataFrame:
    """Autocorrelation per series and lag (D27), long ``(id, lag, acf)``.

    r_k = [sum_{t>k} (y_t - ybar)(y_{t-k} - ybar) / (n-k)] / [sum (y_t - ybar)^2 / n];
    rows with NULL ``y`` are dropped first. With ``block_size`` + ``freq``
    (regular grid without NULLs) the mean is a per-series aggregate joined
    back and the lag products run on time blocks with an ``nlags`` halo; the
    sums are then partially aggregated per series.
    """
    clean = df.filter(F.col(cols.y).isNotNull())

    def products(w):
        return {f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in range(1, nlags + 1)}

    if block_size:
        from seriesspark.operators.features import blocked_window

        means = clean.groupBy(cols.id).agg(F.avg(cols.y).alias("_mean"))
        staged = clean.join(means, cols.id, "inner").select(cols.id, cols.ds,
                                                             (F.col(cols.y) - F.col("_mean")).alias("_d"))
        lagged = blocked_window(staged, cols, freq, block_size, nlags, products)
    else:
        w = Window.partitionBy(cols.id).orderBy(cols.ds)
        dev = F.col(cols.y) - F.avg(cols.y).over(Window.partitionBy(cols.id))
        staged = clean.select(cols.id, cols.ds, dev.alias("_d"))
        lagged = staged.select(cols.id, "_d", *[c.alias(n) for n, c in products(w).items()])
    sums = lagged.groupBy(cols.id).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("_d") * F.col("_d")).alias("_v"),
        *[F.sum(f"_p{k}").alias(f"_p{k}") for k in range(1, nlags + 1)])
    stack = ", ".join(f"{k}, `_p{k}`" for k in range(0, nlags + 1)).replace("`_p0`", "`_v`")
    long = sums.selectExpr(f"`{cols.id}`", "_n", "_v", f"stack({nlags + 1}, {stack}) AS (lag, _s)")
    return long.select(cols.id, "lag",
                       ((F.col("_s") / (F.col("_n") - F.col("lag")))
                        / (F.col("_v") / F.col("_n"))).alias("acf"))


def _durbin_levinson(r: Column, nlags: int) -> Column:
    """PACF array (lag 0 first) from an ACF array, by the Durbin-Levinson recursion as a fold over the lags."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)

    def step(a: Column, k: Column) -> Column:
        past = F.slice(r, 2, k - 1)
        top, bottom = F.get(r, k) - dot(a["phi"], F.reverse(past)), 1 - dot(a["phi"], past)
        # a perfectly predicted series has no partial correlations beyond that lag
        return let(F.when(bottom != 0, top / bottom).otherwise(F.lit(float("nan"))), lambda v: F.struct(
            F.concat(F.zip_with(a["phi"], F.reverse(a["phi"]), lambda x, y: x - v * y), F.array(v)).alias("phi"), F.concat(a["out"], F.array(v)).alias("out")))
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.array(F.lit(1.0)).alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(nlags)), start, step, lambda a: a["out"])


def pacf(df: DataFrame, nlags: int, cols: Cols = DEFAULT, block_size: int | None = None, freq: str | None = None) -> DataFrame:
    """Partial autocorrelation per series and lag (D27), long ``(id, lag, pacf)``.

    The ACF (with ``block_size`` from time blocks) is reduced to one array of
    ``nlags + 1`` values per series, which a fold turns into the PACF.
    """
    arr = acf(df, nlags, cols, block_size, freq).groupBy(cols.id).agg(F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("_a"))
    arr = arr.select(cols.id, let(F.col("_a.acf"), lambda r: _durbin_levinson(r, nlags)).alias("_p"))
    return arr.select(cols.id, F.posexplode("_p").alias("lag", "pacf"))


# ------------------------------------------------------------ correlation

TILE = 256     # series of a tile
STAMPS = 4096  # stamps of a run


def corr_with_targets(df: DataFrame, targets: DataFrame | list, cols: Cols = DEFAULT) -> DataFrame:
    """Pearson correlation of every series with each target series.

    ``targets`` is a table with the id column, or a list of ids; any number of
    them. Series and targets are dealt into tiles whose values, less their series'
    mean, are arrays of some STAMPS stamps. A group multiplies a tile of series with a
    tile of targets over one run of stamps, a second one adds up a pair's runs: no
    timestamp emits pairs of series, no task sees more than two tiles of one run.
    Pairwise-complete observations as in pandas; NULL where a series does not vary.
    Output ``(target, <id>, corr)`` for targets that occur in ``df``.
    """
    if not isinstance(targets, DataFrame):
        targets = df.sparkSession.createDataFrame([(t,) for t in targets], f"`{cols.id}` {df.schema[cols.id].dataType.simpleString()}")
    panel = cut_lineage(df.select(cols.id, cols.ds, F.col(cols.y).cast("double").alias(cols.y)))
    return _correlations(panel, targets.select(cols.id).distinct(), cols)


def _correlations(panel: DataFrame, targets: DataFrame | None, cols: Cols) -> DataFrame:
    """Correlations of a written panel with a table of distinct target ids, all series by default."""
    kind = panel.schema[cols.id].dataType
    means = panel.groupBy(cols.id).agg(F.avg(cols.y).alias("_m"))
    k, stamps = panel.agg(F.count_distinct(cols.id), F.count_distinct(cols.ds)).first()
    n_series = max(1, -(-k // TILE))
    n_targets = n_series if targets is None else max(1, -(-targets.count() // TILE))
    runs = max(1, -(-stamps // STAMPS))
    stamp = F.xxhash64(cols.ds)
    rows = panel.join(means, cols.id).select(F.col(cols.id).alias("name"), stamp.alias("ds"), (F.col(cols.y) - F.col("_m")).alias("v"))
    # NULL values are sent too: a series without a single value still has its pairs
    rows = rows.groupBy("name", F.pmod("ds", F.lit(runs)).cast("int").alias("run")).agg(F.collect_list("ds").alias("ds"), F.collect_list(F.coalesce("v", F.lit(float("nan")))).alias("v"))
    side = lambda rows, own, other, is_target: rows.withColumn("target", F.lit(is_target)) \
        .withColumn("own", F.pmod(F.xxhash64("name"), F.lit(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
    as_target = rows if targets is None else rows.join(targets.select(F.col(cols.id).alias("name")), "name", "left_semi")
    left = side(rows, n_series, n_targets, False).select("name", "run", "ds", "v", "target", F.col("own").alias("i"), F.col("other").alias("j"))
    right = side(as_target, n_targets, n_series, True).select("name", "run", "ds", "v", "target", F.col("other").alias("i"), F.col("own").alias("j"))
    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def products(table: pa.Table) -> pa.Table:
        ds, values = (table.column(c).combine_chunks() for c in ("ds", "v"))
        row = np.repeat(np.arange(len(table)), np.diff(np.asarray(ds.offsets)))
        times, at = np.unique(ds.flatten().to_numpy(), return_inverse=True)
        V = np.full((len(times), len(table)), np.nan)
        V[at, row] = values.flatten().to_numpy()
        M = (~np.isnan(V)).astype(float)
        V = np.nan_to_num(V)
        target = table.column("target").to_numpy()
        X, MX, Y, MY = V[:, ~target], M[:, ~target], V[:, target], M[:, target]
        found = {"n": MX.T @ MY, "sx": X.T @ MY, "sy": MX.T @ Y, "sxx": (X * X).T @ MY, "syy": MX.T @ (Y * Y), "sxy": X.T @ Y}
        names = table.column("name").combine_chunks()
        lists = {c: pa.ListArray.from_arrays([0, int(keep.sum())], names.filter(pa.array(keep))) for c, keep in (("a", ~target), ("b", target))}
        head = table.slice(0, 1)
        return pa.table({"i": head.column("i"), "j": head.column("j"), **lists, **{c: [x.tobytes()] for c, x in found.items()}})

    def correlations(table: pa.Table) -> pa.Table:
        lists = {c: table.column(c).combine_chunks() for c in ("a", "b")}
        names = {c: x.flatten().unique() for c, x in lists.items()}
        place = {c: pc.index_in(x.flatten(), value_set=names[c]).to_numpy() for c, x in lists.items()}
        cut = {c: np.asarray(x.offsets) - np.asarray(x.offsets)[0] for c, x in lists.items()}
        total = {c: np.zeros((len(names["a"]), len(names["b"]))) for c in sums}
        for r in range(len(table)):  # a run lacks the series without a value in it
            a, b = (place[c][cut[c][r]:cut[c][r + 1]] for c in ("a", "b"))
            for c in sums:
                total[c][np.ix_(a, b)] += np.frombuffer(table.column(c)[r].as_py()).reshape(len(a), len(b))
        n, sx, sy, sxx, syy, sxy = (total[c] for c in sums)
        with np.errstate(all="ignore"):
            vx, vy = n * sxx - sx * sx, n * syy - sy * sy
            flat = (vx <= 1e-14 * n * sxx) | (vy <= 1e-14 * n * syy)
            corr = (n * sxy - sx * sy) / np.sqrt(vx * vy)
        i, j = np.divmod(np.arange(corr.size), len(names["b"]))
        return pa.table({"target": names["b"].take(pa.array(j)), cols.id: names["a"].take(pa.array(i)),
                         "corr": pa.array(np.clip(corr, -1, 1).reshape(-1), mask=(flat | ~np.isfinite(corr)).reshape(-1))})

    text = kind.simpleString()
    parts = left.unionByName(right).groupBy("i", "j", "run").applyInArrow(
        products, f"i int, j int, a array<{text}>, b array<{text}>, " + ", ".join(f"{c} binary" for c in sums))
    return parts.groupBy("i", "j").applyInArrow(correlations, f"target {text}, `{cols.id}` {text}, corr double")


def corr_with_target(df: DataFrame, target_id, cols: Cols = DEFAULT) -> DataFrame:
    """Correlation of every series with one target series."""
    return corr_with_targets(df, [target_id], cols)


def corr_matrix(df: DataFrame, ids: DataFrame | list | None = None, cols: Cols = DEFAULT) -> DataFrame:
    """Correlation matrix of all series, or of the listed ones."""
    if ids is None:
        return _correlations(cut_lineage(df.select(cols.id, cols.ds, F.col(cols.y).cast("double").alias(cols.y))), None, cols)
    if not isinstance(ids, DataFrame):
        ids = df.sparkSession.createDataFrame([(t,) for t in ids], f"`{cols.id}` {df.schema[cols.id].dataType.simpleString()}")
    return corr_with_targets(df.join(ids.select(cols.id).distinct(), cols.id, "left_semi"), ids, cols)


def top_correlations(df: DataFrame, target_id, k: int = 10, cols: Cols = DEFAULT) -> DataFrame:
    """Series most correlated with a target by absolute value."""
    c = corr_with_target(df, target_id, cols)
    return (c.withColumn("abs_corr", F.abs("corr"))
            .orderBy(F.desc("abs_corr"), F.asc(cols.id)).limit(k))


# ------------------------------------------------------------ shape and profile

def wide_panel(df: DataFrame, cols: Cols = DEFAULT, ids: list[str] | None = None) -> DataFrame:
    """Long to wide: one row per timestamp, one column per series."""
    return df.groupBy(cols.ds).pivot(cols.id, ids).agg(F.first(cols.y))


def series_lengths(df: DataFrame, cols: Cols = DEFAULT, min_length: int = 0) -> DataFrame:
    """Rows and non-null targets per series, optional length filter."""
    out = df.groupBy(cols.id).agg(F.count(F.lit(1)).alias("n_rows"), F.count(cols.y).alias("n_obs"))
    return out.filter(F.col("n_rows") >= min_length) if min_length else out


def histogram(values: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram ``(bin, lo, hi, count)``.

    Bounds come from scalar subqueries; the maximum falls in the last bin;
    one bin when all values are equal.
    """
    lo = values.select(F.min(col)).scalar()
    hi = values.select(F.max(col)).scalar()
    width = (hi - lo) / F.lit(bins)
    b = F.when(hi == lo, F.lit(1)).otherwise(
        F.least(F.lit(bins), F.floor((F.col(col) - lo) / width).cast("int") + 1))
    return (values.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (lo + (F.col("bin") - 1) * width).cast("double").alias("lo"),
                    (lo + F.col("bin") * width).cast("double").alias("hi"), "count"))


def series_records(df: DataFrame, target: str, covariates: list[str], cols: Cols = DEFAULT,
                   element_type: str = "float") -> DataFrame:
    """One record per series: ordered ``target`` array and a covariate map.

    ``collect_list`` drops NULLs, so values are collected as structs ordered
    by time and projected afterwards; array lengths always equal the row
    count.
    """
    st = F.sort_array(F.collect_list(F.struct(cols.ds, target, *covariates)))
    g = df.groupBy(cols.id).agg(st.alias("_r"))
    cov = F.map_from_arrays(F.array(*[F.lit(c) for c in covariates]),
                            F.array(*[F.col(f"_r.{c}").cast(f"array<{element_type}>") for c in covariates]))
    return g.select(cols.id, F.col(f"_r.{target}").cast(f"array<{element_type}>").alias("target"),
                    cov.alias("past_covariates"))
