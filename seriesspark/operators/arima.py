"""ARIMA and its order search from lag moments, as Spark expressions.

A series' least-squares fits need only sums of products of its lagged values. One
window pass lays the lags beside each row, a partial aggregate sums the products per
series, and the small systems are solved by elimination on arrays. So a series of any
length is rows and partial sums, never one task's array; with ``block_size`` the lags
come from time blocks with halos too. No Python runs on the executors.

* ARIMA(p,d,q) (F4, Hannan and Rissanen 1982): difference d times; innovations are the
  residuals of an autoregression of order P = max(1, min(10, floor((n - d) / 4))), 0 for
  the first P; least squares on p lags and q innovations over the rows after the first
  P + max(p, q); future innovations 0; differences undone. Series of P + max(p, q) + 2
  differenced values or fewer repeat their last value.
* AutoARIMA (F5): p, q up to 5, d up to 2. The moments of all lags and innovations over
  the rows that every candidate has hold every candidate's system; each is solved by
  elimination, and the smallest AICc = n ln(SSE / n) + 2 k + 2 k (k + 1) / (n - k - 1),
  k = p + q + 1, wins, ties by (d, p, q). The forecast uses the winner's coefficients on
  those rows. Series with fewer than three such rows for any candidate repeat their last value.

A column of a system that depends on those before it (pivot under 1e-10 of its sum of
squares) gets coefficient 0. NULL targets count as 0. Grids must be regular for ``block_size``.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesspark.functions.contracts import DEFAULT, Cols
from seriesspark.operators.forecast import positions
from seriesspark.operators.grid import horizon_grid
from seriesspark.session import cut_lineage

LONG = 10                     # order of the autoregression for innovations, at most
MAX_P, MAX_D, MAX_Q = 5, 2, 5
PART_ROWS = 100_000           # rows of one partition of the order search


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def solve(m: Column) -> Column:
    """Solutions of the augmented rows ``m`` (array of arrays), by Gauss-Jordan elimination."""
    scale = F.transform(m, lambda row, i: row[i])

    def pivot(a: Column, c: Column) -> Column:
        def reduced(r: Column) -> Column:
            unit = F.transform(r, lambda v: v / r[c - 1])
            return let(unit, lambda u: F.transform(a["m"], lambda row, i: F.when(i == c - 1, u).otherwise(F.zip_with(row, u, lambda v, w: v - row[c - 1] * w))))
        zeroed = F.transform(a["m"], lambda row, i: F.when(i == c - 1, F.transform(row, lambda _v: F.lit(0.0))).otherwise(row))
        rest = let(F.element_at(a["m"], c), lambda r: F.when(r[c - 1] > 1e-10 * a["scale"][c - 1], reduced(r)).otherwise(zeroed))
        return F.struct(rest.alias("m"), a["scale"].alias("scale"))

    return let(m, lambda m_: F.aggregate(F.sequence(F.lit(1), F.size(m_)), F.struct(m_.alias("m"), scale.alias("scale")), pivot,
                                         lambda a: F.transform(a["m"], lambda row: F.element_at(row, -1))))


def gram(x: list[Column], y: Column) -> Column:
    """Aggregate: the rows of ``[x, y]`` products summed, ``x`` by ``[x..., y]``, as an array of arrays; the last row is y's own."""
    every = [*x, y]
    sums = {(i, j): F.sum(every[i] * every[j]) for i in range(len(every)) for j in range(i, len(every))}
    return F.array(*[F.array(*[F.coalesce(sums[min(i, j), max(i, j)], F.lit(0.0)) for j in range(len(every))]) for i in range(len(every))])


def _windowed(df: DataFrame, cols: Cols, freq: str, block_size: int | None, halo: int, columns) -> DataFrame:
    if block_size:
        from seriesspark.operators.features import blocked_window
        return blocked_window(df, cols, freq, block_size, halo, columns).drop("_pblk")
    w = Window.partitionBy(cols.id).orderBy(cols.ds)
    return df.select("*", *[c.alias(n) for n, c in columns(w).items()])


def _innovations(rows: DataFrame, d: int, keep: int, cols: Cols, freq: str, block_size: int | None) -> DataFrame:
    """``rows`` (positions) with ``_z``, its lags ``_z1 ..``, ``_P``, the innovation ``_e`` and its lags ``_e1 ..`` (``keep`` each)."""
    def lags(w):
        y = [F.col(cols.y), *[F.lag(cols.y, k).over(w) for k in range(1, LONG + d + 1)]]
        diff = lambda i, k: sum(((-1) ** j * comb(k, j) * y[i + j] for j in range(1, k + 1)), y[i])
        return {**{f"_z{i or ''}": diff(i, d) for i in range(LONG + 1)}, **{f"_l{k}": diff(0, k) for k in range(d)}}

    staged = _windowed(rows, cols, freq, block_size, LONG + d, lags)
    staged = staged.withColumn("_P", F.greatest(F.lit(1), F.least(F.lit(LONG), F.floor((F.col("_n") - d) / 4))).cast("int"))
    used = F.col("_rn") > d + F.col("_P")
    x = [F.lit(1.0), *[F.when(F.lit(i) <= F.col("_P"), F.col(f"_z{i}")).otherwise(0.0) for i in range(1, LONG + 1)]]
    beta = staged.where(used).groupBy(cols.id).agg(gram(x, F.col("_z")).alias("_g")) \
        .select(F.col(cols.id).alias("_bid"), solve(F.slice("_g", 1, LONG + 1)).alias("_b"))
    fitted = sum((F.col("_b")[i] * v for i, v in enumerate(x[1:], 1)), F.col("_b")[0])
    staged = staged.join(beta, F.col(cols.id) == F.col("_bid"), "left").withColumn("_e", F.when(used, F.col("_z") - fitted).when(F.col("_rn") > d, F.lit(0.0)))
    staged = staged.drop("_b", "_bid")
    return _windowed(staged, cols, freq, block_size, keep, lambda w: {f"_e{j}": F.lag("_e", j).over(w) for j in range(1, keep + 1)})


def _last(d: int, keep: int, cols: Cols) -> list[Column]:
    """Aggregates: last stamp and value, the last ``keep`` values and innovations (newest first), the last value of each difference."""
    last = lambda c: F.max_by(c, cols.ds)
    lagged = lambda prefix: F.array(*[F.col(f"{prefix}{i or ''}") for i in range(keep)])
    return [F.max(cols.ds).alias("_last_ds"), last(F.col(cols.y)).alias("_last_y"), last(lagged("_z")).alias("_zs"), last(lagged("_e")).alias("_es"),
            last(F.array(*[F.col(f"_l{k}") for k in range(d)]) if d else F.array().cast("array<double>")).alias("_ends")]


def _ahead(coef: Column, p: Column, q: Column, h: int) -> Column:
    """Forecasts of the differenced series from ``coef`` (intercept, p, q), its last values and innovations."""
    def step(a: Column, _k: Column) -> Column:
        part = lambda values, first, n: F.aggregate(F.sequence(F.lit(1), F.lit(MAX_P)), F.lit(0.0),
                                                    lambda s, i: s + F.when(i <= n, F.coalesce(F.get(coef, first + i - 1) * F.get(values, i - 1), F.lit(0.0))).otherwise(0.0))
        v = coef[0] + part(a["z"], F.lit(1), p) + part(a["e"], 1 + p, q)
        return let(v, lambda x: F.struct(F.concat(F.array(x), a["z"]).alias("z"), F.concat(F.array(F.lit(0.0)), a["e"]).alias("e"), F.concat(a["out"], F.array(x)).alias("out")))
    start = F.struct(F.col("_zs").alias("z"), F.col("_es").alias("e"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(h)), start, step, lambda a: a["out"])


def _integrated(out: Column, ends: Column) -> Column:
    """Differences undone: a running sum from each level's last value, the innermost first."""
    def undo(values: Column, end: Column) -> Column:
        run = F.aggregate(values, F.struct(end.alias("s"), F.array().cast("array<double>").alias("out")),
                          lambda a, v: F.struct((a["s"] + v).alias("s"), F.concat(a["out"], F.array(a["s"] + v)).alias("out")))
        return run["out"]
    return F.aggregate(F.reverse(ends), out, undo)


def _rows(found: DataFrame, h: int, freq: str, model: str, cols: Cols, extra: tuple[str, ...] = ()) -> DataFrame:
    g = horizon_grid(found.select(cols.id, "_last_ds", "_f", *extra), h, freq, cols)
    return g.select(cols.id, cols.ds, F.lit(model).alias("model"), *extra, F.col("_f")[F.col("k") - 1].alias("yhat"))


def _ready(df: DataFrame, cols: Cols, freq: str, block_size: int | None) -> DataFrame:
    y = df.select(cols.id, cols.ds, F.coalesce(F.col(cols.y).cast("double"), F.lit(0.0)).alias(cols.y))
    return positions(y, cols, freq, block_size)


def arima(df: DataFrame, order: tuple[int, int, int], h: int, freq: str, cols: Cols = DEFAULT, block_size: int | None = None) -> DataFrame:
    """Long forecasts ``(id, ds, model, yhat)`` of ARIMA(p,d,q)."""
    p, d, q = order
    if p > MAX_P or q > MAX_Q or d > MAX_D:
        raise ValueError(f"order {order} beyond ({MAX_P}, {MAX_D}, {MAX_Q})")
    keep = max(p, q, 1)
    rows = _innovations(_ready(df, cols, freq, block_size), d, keep, cols, freq, block_size)
    used = F.col("_rn") > d + F.col("_P") + max(p, q)
    x = [F.lit(1.0), *[F.col(f"_z{i}") for i in range(1, p + 1)], *[F.col(f"_e{j}") for j in range(1, q + 1)]]
    only = [F.when(used, c) for c in x]
    s = rows.groupBy(cols.id).agg(gram(only, F.when(used, F.col("_z"))).alias("_g"), F.max("_n").alias("_n"), F.max("_P").alias("_P"), *_last(d, keep, cols))
    s = s.withColumn("_coef", F.when(F.col("_n") - d > F.col("_P") + max(p, q) + 2, solve(F.slice("_g", 1, 1 + p + q))))
    s = s.withColumn("_f", F.when(F.col("_coef").isNotNull(), _integrated(_ahead(F.col("_coef"), F.lit(p), F.lit(q), h), F.col("_ends")))
                     .otherwise(F.array_repeat("_last_y", h)))
    return _rows(s, h, freq, "ARIMA", cols)


def _candidates(d: int) -> Column:
    """``p, q, at``: the rows of the full system that each candidate uses."""
    return F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.array(*[F.lit(i) for i in [0, *range(1, p + 1), *range(MAX_P + 1, MAX_P + q + 1)]]).alias("at"))
                     for p in range(MAX_P + 1) for q in range(MAX_Q + 1)])


def auto_arima(df: DataFrame, h: int, freq: str, cols: Cols = DEFAULT, block_size: int | None = None) -> DataFrame:
    """Long forecasts ``(id, ds, model, order, yhat)`` of the order with the smallest AICc."""
    ready, target = cut_lineage(_ready(df, cols, freq, block_size)), 1 + MAX_P + MAX_Q  # read for every d
    if not block_size:  # laid out with all its lags a row is wide: partitions by rows, not by the few bytes shuffled
        ready = ready.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-ready.count() // PART_ROWS)), cols.id)
    found = None
    for d in range(MAX_D + 1):
        rows = _innovations(ready, d, max(MAX_P, MAX_Q), cols, freq, block_size)
        # the same rows of the series for every candidate
        used = F.col("_rn") > F.greatest(F.lit(1), F.least(F.lit(LONG), F.floor(F.col("_n") / 4))) + max(MAX_P, MAX_Q) + MAX_D
        x = [F.lit(1.0), *[F.col(f"_z{i}") for i in range(1, MAX_P + 1)], *[F.col(f"_e{j}") for j in range(1, MAX_Q + 1)]]
        s = rows.groupBy(cols.id).agg(gram([F.when(used, c) for c in x], F.when(used, F.col("_z"))).alias("_g"), *_last(d, max(MAX_P, MAX_Q), cols))

        def score(c: Column) -> Column:
            g = F.col("_g")
            sub = F.transform(c["at"], lambda i: F.concat(F.transform(c["at"], lambda j: g[i][j]), F.array(g[i][target])))  # noqa: B023
            def judged(b: Column) -> Column:
                sse = g[target][target] - F.aggregate(F.arrays_zip(b.alias("b"), c["at"].alias("i")), F.lit(0.0), lambda a, e: a + e["b"] * g[e["i"]][target])  # noqa: B023
                n, k = g[0][0], F.size(b)  # noqa: B023
                fit = F.when((n >= 3) & (n - k - 1 > 0) & (sse > 0), n * F.log(sse / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1))
                return F.struct(fit.alias("aicc"), F.lit(d).alias("d"), c["p"].alias("p"), c["q"].alias("q"), b.alias("coef"))  # noqa: B023
            return let(solve(sub), judged)

        scored = F.filter(F.transform(_candidates(d), score), lambda c: c["aicc"].isNotNull())
        s = s.select(cols.id, "_last_ds", "_last_y", "_zs", "_es", "_ends", F.array_min(scored).alias("_c"))
        found = s if found is None else found.unionByName(s)
    # the winner of all differences; without any candidate the last value
    best = F.min_by(F.struct("_last_ds", "_last_y", "_zs", "_es", "_ends", "_c"), F.struct(F.coalesce(F.col("_c.aicc"), F.lit(float("inf"))).alias("aicc"), "_c.d", "_c.p", "_c.q"))
    s = found.groupBy(cols.id).agg(best.alias("_w")).select(cols.id, "_w.*")
    ahead = _integrated(_ahead(F.col("_c.coef"), F.col("_c.p"), F.col("_c.q"), h), F.col("_ends"))
    s = s.withColumn("_f", F.when(F.col("_c").isNotNull(), ahead).otherwise(F.array_repeat("_last_y", h)))
    s = s.withColumn("order", F.when(F.col("_c").isNotNull(), F.format_string("(%d,%d,%d)", F.col("_c.p"), F.col("_c.d"), F.col("_c.q"))))
    return _rows(s, h, freq, "AutoARIMA", cols, ("order",))
