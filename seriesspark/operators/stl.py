"""Seasonal-trend decomposition by loess as array expressions.

On a regular grid the loess value at a place is a fixed weighted sum of the ``span``
nearest values, so a smoother is one table of weights: a row per place among them
(the middle row inside the series, the others near its ends). STL (Cleveland et al.
1990; inner 2, outer 0): cycle-subseries are smoothed and extended by a cycle at both
ends, the low pass is two moving averages of a cycle, one of 3 and a loess, and the
trend a loess of the deseasonalised values, whose span is the smallest odd number from
1.5 m / (1 - 1.5 / seasonal window) on.

A series is one array; with ``block_size`` it is cut into blocks whose arrays reach as
far into their neighbours as any value can come from (``reach``), so long series are
spread over tasks with the same results. No Python runs on the executors.

NULL targets count as 0; series under two cycles give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesspark.functions.contracts import DEFAULT, Cols
from seriesspark.functions.frequency import step_forward, step_index
from seriesspark.operators.arima import let

SEASONAL, INNER = 7, 2


def loess_weights(n: int, span: int, places: Sequence[int]) -> list[list[float]]:
    """Weights of ``n`` values 0 .. n - 1 for the local line at each place, the bandwidth stretched where ``n`` is below ``span``."""
    out = []
    for x0 in places:
        d = [abs(i - x0) for i in range(n)]
        top = max(max(d), 1e-12) * max(1.0, span / n if n < span else 1.0) * 1.000001
        w = [(1 - (x / top) ** 3) ** 3 for x in d]
        total = sum(w)
        middle = sum(a * i for i, a in enumerate(w)) / total
        spread = sum(a * (i - middle) ** 2 for i, a in enumerate(w))
        tilt = (x0 - middle) / spread if spread > 1e-12 else 0.0
        out.append([a / total + tilt * a * (i - middle - sum(b * (j - middle) for j, b in enumerate(w)) / total) for i, a in enumerate(w)])
    return out


def _literal(table: list) -> Column:
    """A nested list as one constant column."""
    depth = "array<array<double>>" if not isinstance(table[0][0], list) else "array<array<array<double>>>"
    return F.from_json(F.lit(str(table).replace("'", "")), depth)


def _tables(span: int, least: int, beyond: int) -> Column:
    """Weight tables for ``n = least .. span`` values, for places from ``-beyond`` to ``n - 1 + beyond``."""
    return _literal([loess_weights(n, span, range(-beyond, n + beyond)) for n in range(min(least, span), span + 1)])


def loess(values: Column, tables: Column, span: int, least: int, beyond: int = 0) -> Column:
    """The loess of an array at its places, and ``beyond`` places at each end."""
    n = F.size(values)
    q = F.least(n, F.lit(span))
    table = F.get(tables, q - min(least, span))

    def at(i: Column) -> Column:
        first = F.greatest(F.least(i - (span // 2), n - q), F.lit(0))
        return F.aggregate(F.zip_with(F.slice(values, first + 1, q), F.get(table, i - first + beyond), lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(-beyond), n - 1 + beyond), at)


def moving_average(values: Column, k: int) -> Column:
    """Means of ``k`` neighbours, ``k - 1`` fewer values."""
    return F.transform(F.sequence(F.lit(0), F.size(values) - k), lambda i: F.aggregate(F.slice(values, i + 1, k), F.lit(0.0), lambda a, x: a + x) / k)


def spans(m: int) -> tuple[int, int]:
    """Spans of the low-pass and the trend loess."""
    trend = ceil(1.5 * m / (1 - 1.5 / SEASONAL))
    return m + (m % 2 == 0), trend + (trend % 2 == 0)


def reach(m: int) -> int:
    """Steps from which a value can come, over all inner rounds."""
    low, trend = spans(m)
    return INNER * (SEASONAL // 2 * m + m + 2 + low // 2 + trend // 2)


def decompose(values: Column, m: int) -> Column:
    """``struct(trend, season)`` arrays of an array of at least two cycles.

    Every step is bound to a name (``let``), so that it is computed once per series
    and not again for each place that looks it up.
    """
    low_span, trend_span = spans(m)
    n = F.size(values)

    def rounds(y: Column, trend: Column, left: int, cycles: Column, low: Column, wide: Column) -> Column:
        sub = lambda free: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda p: F.transform(
            F.sequence(F.lit(0), F.floor((n - 1 - p) / m).cast("int")), lambda k: F.get(free, p + k * m)))
        smooth = lambda subs: F.transform(subs, lambda x: loess(x, cycles, SEASONAL, 2, 1))
        joined = lambda parts: F.transform(F.sequence(F.lit(0), n + 2 * m - 1), lambda i: F.get(F.get(parts, i % m), F.floor(i / m).cast("int")))
        passed = lambda c: let(moving_average(c, m), lambda x: let(moving_average(x, m), lambda z: let(moving_average(z, 3), lambda v: loess(v, low, low_span, 2 * m))))

        def close(season: Column) -> Column:
            next_trend = let(F.zip_with(y, season, lambda v, x: v - x), lambda rest: loess(rest, wide, trend_span, 2 * m))
            if left == 1:
                return F.struct(next_trend.alias("trend"), season.alias("season"))
            return let(next_trend, lambda t: rounds(y, t, left - 1, cycles, low, wide))

        return let(F.zip_with(y, trend, lambda v, t: v - t), lambda free: let(sub(free), lambda subs: let(smooth(subs), lambda parts: let(joined(parts), lambda cycle: let(
            F.zip_with(F.slice(cycle, F.lit(m + 1), n), passed(cycle), lambda c, x: c - x), close)))))

    zero = F.transform(values, lambda _v: F.lit(0.0))
    return let(_tables(SEASONAL, 2, 1), lambda c: let(_tables(low_span, 2 * m, 0), lambda low: let(_tables(trend_span, 2 * m, 0), lambda w: rounds(values, zero, INNER, c, low, w))))


def stl_features(df: DataFrame, season_length: int, h: int, freq: str, cols: Cols = DEFAULT, block_size: int | None = None) -> DataFrame:
    """STL trend/seasonal as features for history and for ``h`` future rows.

    Future trend: last level plus the mean of the last ``m`` trend steps; future
    seasonal: the last cycle repeated. One frame ``(id, ds, trend, seasonal, part)``
    with ``part`` history or future.
    """
    m, halo = season_length, reach(season_length)
    y = F.coalesce(F.col(cols.y).cast("double"), F.lit(0.0))
    rows = df.select(cols.id, cols.ds, y.alias("_v"))
    if block_size:
        block_size = max(block_size, 2 * m)
        idx = step_index(F.col(cols.ds), freq)
        span = rows.groupBy(cols.id).agg(F.max(idx).alias("_hi"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2 * m)
        rows = rows.join(span, cols.id).withColumn("_i", F.col("_hi") - idx)  # steps before the series' end
        # blocks count from the end; what is left of a block at the start joins its neighbour
        of = lambda i: F.least(F.floor(i / block_size), F.greatest(F.floor(F.col("_n") / block_size) - 1, F.lit(0)))
        near = F.sequence(of(F.greatest(F.col("_i") - halo, F.lit(0))), of(F.least(F.col("_i") + halo, F.col("_n") - 1)))
        rows = rows.withColumn("_own", of(F.col("_i"))).withColumn("_block", F.explode(near)).withColumn("_mine", F.col("_own") == F.col("_block"))
    else:
        rows = rows.withColumns({"_block": F.lit(0).cast("bigint"), "_mine": F.lit(True)})
    point = F.struct(F.col(cols.ds).alias("t"), F.col("_v").alias("v"), F.col("_mine").alias("own"))
    s = rows.groupBy(cols.id, "_block").agg(F.sort_array(F.collect_list(point)).alias("_s")).where(F.size("_s") >= 2 * m)
    s = s.select(cols.id, "_block", F.col("_s.t").alias("_t"), F.col("_s.own").alias("_mine"), let(F.col("_s.v"), lambda y: decompose(y, m)).alias("_d"))
    s = s.select(cols.id, "_block", "_t", "_mine", F.col("_d.trend").alias("_trend"), F.col("_d.season").alias("_season"))
    history = s.select(cols.id, F.explode(F.arrays_zip("_t", "_trend", "_season", "_mine")).alias("_e")).where("_e._mine") \
        .select(cols.id, F.col("_e._t").alias(cols.ds), F.col("_e._trend").alias("trend"), F.col("_e._season").alias("seasonal"), F.lit("history").alias("part"))
    last, n = F.element_at("_trend", -1), F.size("_t")
    slope = F.when(n > m, (last - F.get("_trend", n - 1 - m)) / m).otherwise(0.0)
    steps = F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: F.struct(k.alias("k"), (last + slope * k).alias("trend"), F.get("_season", n - m + (k - 1) % m).alias("seasonal")))
    future = s.where("_block = 0").select(cols.id, F.element_at("_t", -1).alias("_last"), F.explode(steps).alias("_e")) \
        .select(cols.id, step_forward(F.col("_last"), F.col("_e.k"), freq).alias(cols.ds), F.col("_e.trend").alias("trend"), F.col("_e.seasonal").alias("seasonal"), F.lit("future").alias("part"))
    return history.unionByName(future)
