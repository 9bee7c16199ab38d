"""Supervised training windows.

A window is keyed by ``(series, cutoff)``: ``input`` holds the ``L`` values
ending at the cutoff row, ``output`` the ``H`` values after it. Windows are
computed as arrays, so the
"billions of rows" long layout is never materialised unless asked for
(``windows_long``). Cutoff rows ``c`` run from ``L`` to ``n-H`` and are kept
when ``(n-H-c) % step == 0``; the count is ``floor((n-H-L)/step)+1`` when
``n >= L+H`` (the reference's ``int(n - (h+L)/step)`` has a precedence error).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesspark.functions.contracts import DEFAULT, Cols
from seriesspark.functions.frequency import step_forward
from seriesspark.operators.forecast import positions


def window_count(n: int, input_size: int, h: int, step: int = 1, legacy: bool = False) -> int:
    """Number of windows of a series of length ``n`` (Q3 fixed; ``legacy`` = reference)."""
    if legacy:
        return int(n - (h + input_size) / step)
    return (n - h - input_size) // step + 1 if n >= input_size + h else 0


CHUNK = 1024  # cutoffs whose values meet in one row, at least


def _legal(input_size: int, h: int, step: int):
    """Whether a row position is a cutoff, from ``_rn`` and ``_n``."""
    return (F.col("_rn") >= input_size) & (F.col("_rn") <= F.col("_n") - h) & ((F.col("_n") - h - F.col("_rn")) % step == 0)


def _chunks(rn, size: int, before: int, after: int):
    """Chunks of ``size`` cutoffs that need row ``rn``: those of cutoffs from ``rn - after`` to ``rn + before``."""
    last = F.floor((F.col("_n") - 1) / size)
    return F.sequence(F.greatest(F.floor((rn - after - 1) / size), F.lit(0)), F.least(F.floor((rn + before - 1) / size), last))


def window_arrays(df: DataFrame, input_size: int, h: int, step: int = 1,
                  cols: Cols = DEFAULT, element_type: str = "float",
                  block_size: int | None = None, freq: str | None = None) -> DataFrame:
    """``(id, cutoff, input, output)`` for every legal window.

    Rows are dealt into chunks of ``block_size`` cutoffs with the ``L-1`` rows before
    and ``H`` rows after them; a chunk is one ordered array, from which its windows are
    sliced. So a row holds some thousand values whatever the series' length. With
    ``freq`` (regular grid) positions come from the grid index, so that no series is
    confined to one task; without it from a row number per series. A NULL ``y`` keeps its slot.
    """
    size = block_size or max(CHUNK, 4 * (input_size + h))
    ranked = positions(df, cols, freq, size if freq else None).where(F.col("_n") >= input_size + h)
    rn = F.col("_rn")
    dealt = ranked.withColumn("_chunk", F.explode(_chunks(rn, size, input_size - 1, h)))
    s = dealt.groupBy(cols.id, "_chunk").agg(F.max("_n").alias("_n"), F.sort_array(F.collect_list(
        F.struct(rn.alias("rn"), F.col(cols.ds).alias("t"), F.col(cols.y).alias("v")))).alias("_s"))
    s = s.withColumn("_at", F.get("_s", F.lit(0))["rn"])   # position of the chunk's first row
    lo = F.greatest(F.col("_chunk") * size + 1, F.lit(input_size))
    lo = lo + F.pmod(F.col("_n") - h - lo, F.lit(step))
    hi = F.least((F.col("_chunk") + 1) * size, F.col("_n") - h)
    values = lambda at, k: F.transform(F.slice("_s", at.cast("int"), k), lambda p: p["v"]).cast(f"array<{element_type}>")
    place = lambda c: c - F.col("_at") + 1
    cuts = F.transform(F.sequence(lo, hi, F.lit(step).cast("bigint")), lambda c: F.struct(
        F.get("_s", (c - F.col("_at")).cast("int"))["t"].alias("cutoff"), values(place(c) - input_size + 1, input_size).alias("input"),
        values(place(c) + 1, h).alias("output")))
    return s.where(lo <= hi).select(cols.id, F.inline(cuts))


def windows_long(arrays: DataFrame, input_size: int, freq: str, cols: Cols = DEFAULT) -> DataFrame:
    """Stack windows into labelled long rows (W12): ``(id, ds, y, cutoff, data_type)``.

    ``ds`` is recomputed from the cutoff and the position, which is exact on
    a regular grid (the input of ``window_arrays`` must be gap-filled).
    """
    inp = arrays.select(cols.id, "cutoff", F.posexplode("input").alias("_p", cols.y)) \
        .withColumn("ds", step_forward(F.col("cutoff"), F.col("_p") - (input_size - 1), freq)) \
        .withColumn("data_type", F.lit("input"))
    out = arrays.select(cols.id, "cutoff", F.posexplode("output").alias("_p", cols.y)) \
        .withColumn("ds", step_forward(F.col("cutoff"), F.col("_p") + 1, freq)) \
        .withColumn("data_type", F.lit("output"))
    return inp.unionByName(out).select(cols.id, F.col("ds").alias(cols.ds), F.col(cols.y).cast("double").alias(cols.y),
                                       "cutoff", "data_type")


def windows_range_join(df: DataFrame, input_size: int, h: int, step: int = 1,
                       cols: Cols = DEFAULT, freq: str | None = None) -> DataFrame:
    """Long windows by a bounded range join on ``(id, rn)``.

    Cutoff ``c`` is joined to the rows with ``rn`` in ``(c-L, c+H]`` of its series. Both sides
    meet by ``(id, chunk)`` with chunks of ``L+H`` positions: a cutoff is sent once, a
    row to the two or three chunks whose cutoffs can reach it, and a chunk tests at most three
    pairs per result. With ``freq`` (regular grid) positions come from the grid index.
    """
    size = input_size + h
    ranked = positions(df, cols, freq, size if freq else None)
    cut = ranked.filter(_legal(input_size, h, step)).select(
        F.col(cols.id).alias("_cid"), F.col("_rn").alias("_c"), F.col(cols.ds).alias("cutoff"), F.floor((F.col("_rn") - 1) / size).alias("_cc"))
    rows = ranked.withColumn("_chunk", F.explode(_chunks(F.col("_rn"), size, input_size - 1, h)))
    j = cut.join(rows, (F.col("_cid") == F.col(cols.id)) & (F.col("_cc") == F.col("_chunk"))
                 & (F.col("_rn") > F.col("_c") - input_size) & (F.col("_rn") <= F.col("_c") + h))
    return j.select(cols.id, cols.ds, cols.y, "cutoff",
                    F.when(F.col("_rn") <= F.col("_c"), "input").otherwise("output").alias("data_type"))


def sequence_pairs(long: DataFrame, input_size: int, output_size: int,
                   cols: Cols = DEFAULT) -> DataFrame:
    """Sequence pairs from long windows, keyed by (series, cutoff).

    The last ``input_size`` input values and the first ``output_size`` output
    values, kept only when both are complete. Keying by the pair avoids the
    reference's mixing of series that share a cutoff.
    """
    g = long.groupBy(cols.id, "cutoff").agg(
        F.sort_array(F.collect_list(F.when(F.col("data_type") == "input", F.struct(cols.ds, cols.y)))).alias("_i"),
        F.sort_array(F.collect_list(F.when(F.col("data_type") == "output", F.struct(cols.ds, cols.y)))).alias("_o"))
    inp = F.slice(F.col(f"_i.{cols.y}"), -input_size, input_size)
    out = F.slice(F.col(f"_o.{cols.y}"), 1, output_size)
    return (g.select(cols.id, "cutoff", inp.cast("array<float>").alias("input"),
                     out.cast("array<float>").alias("output"))
            .filter((F.size("input") == input_size) & (F.size("output") == output_size)))
