"""Regular grids and gap filling.

Gap filling is one window stage per series and needs no join: every observed
row *owns* the grid points from its own stamp up to the step before the next
observation (the first row also owns the leading points from the start
bound; the last row owns the trailing points to the end bound). Exploding
that range generates the scaffold where the series already lives, and the
values to carry are computed in the same window pass:

* additive measures (``zero_cols``) are 0 on generated points (P13);
* carried measures (``carry_cols``) are forward filled, then backward filled
  for the leading gap (W3, W4): for every point owned by row r this equals
  ``coalesce(ffill(r), bfill(r))``;
* any other column is NULL on generated points.

Global bounds enter as one scalar subquery with two fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesspark.functions.contracts import DEFAULT, Cols
from seriesspark.functions.frequency import interval, step_forward, step_index


def forward_fill(col: str, id_col: str, ds_col: str) -> Column:
    """Last non-null value at or before the row."""
    w = (Window.partitionBy(id_col).orderBy(ds_col)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.last(F.col(col), ignorenulls=True).over(w)


def backward_fill(col: str, id_col: str, ds_col: str) -> Column:
    """First non-null value at or after the row.

    Written as a running ``last`` over the reversed order: a frame ending at
    ``unboundedFollowing`` is re-aggregated for every row (quadratic in the
    series length), a frame starting at ``unboundedPreceding`` is
    incremental. Same partitioning, so no extra shuffle, one extra sort.
    """
    w = (Window.partitionBy(id_col).orderBy(F.col(ds_col).desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.last(F.col(col), ignorenulls=True).over(w)


def ffill_bfill(col: str, id_col: str, ds_col: str) -> Column:
    """Forward fill, then backward fill of the leading gap (W3 + W4)."""
    return F.coalesce(forward_fill(col, id_col, ds_col), backward_fill(col, id_col, ds_col))


def _bounds(df: DataFrame, ds: str, start: str, end: str) -> tuple[Column | None, Column | None]:
    """Start and end bound; global ones are the two fields of one scalar subquery."""
    both = None
    if "global" in (start, end):
        both = df.select(F.struct(F.min(ds).alias("lo"), F.max(ds).alias("hi")).alias("b")).scalar()

    def bound(which: str, field: str) -> Column | None:
        if which == "per_serie":
            return None
        return both[field] if which == "global" else F.lit(which).cast("timestamp_ntz")

    return bound(start, "lo"), bound(end, "hi")


def _on_grid(nxt: Column, cols: Cols, freq: str) -> Column:
    """The next stamp, or an error that names the series when it is a repeat or off the grid."""
    ds = F.col(cols.ds)
    steps = step_index(nxt, freq) - step_index(ds, freq)
    bad = nxt.isNotNull() & ((nxt <= ds) | (step_forward(ds, steps, freq) != nxt))
    message = F.concat(F.lit("series "), F.col(cols.id).cast("string"), F.lit(" has a repeated or off-grid stamp after "),
                       ds.cast("string"), F.lit(f" for frequency {freq}"))
    return F.when(bad, F.raise_error(message).cast("timestamp_ntz")).otherwise(nxt)


def _blocked_neighbours(df: DataFrame, cols: Cols, freq: str, block_size: int, carry_cols: list[str]):
    """Next stamp, first-row flag and carried values, evaluated on time blocks.

    Within a block they come from a window on ``(id, block)``; across block
    boundaries from one summary row per block (first stamp, last and first
    non-null value of each carried column) and a window over the few blocks
    of a series. A series holding a third of all rows is thus spread over
    ``n / block_size`` tasks.
    """
    staged = df.withColumn("_blk", F.floor(step_index(F.col(cols.ds), freq) / block_size))
    aggs = [F.min(cols.ds).alias("_bmin")]
    for c in carry_cols:
        nn_ds = F.when(F.col(c).isNotNull(), F.col(cols.ds))
        aggs += [F.max_by(F.col(c), nn_ds).alias(f"_blast_{c}"), F.min_by(F.col(c), nn_ds).alias(f"_bfirst_{c}")]
    blocks = staged.groupBy(cols.id, "_blk").agg(*aggs)
    wb = Window.partitionBy(cols.id).orderBy("_blk")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    after = (Window.partitionBy(cols.id).orderBy(F.col("_blk").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    info = [F.lead("_bmin").over(wb).alias("_next_min"), (F.row_number().over(wb) == 1).alias("_first_blk")]
    for c in carry_cols:
        info += [F.last(f"_blast_{c}", ignorenulls=True).over(before).alias(f"_prev_{c}"),
                 F.last(f"_bfirst_{c}", ignorenulls=True).over(after).alias(f"_next_{c}")]
    blocks = blocks.select(cols.id, "_blk", *info)
    j = staged.join(blocks, [cols.id, "_blk"], "inner")
    w = Window.partitionBy(cols.id, "_blk").orderBy(cols.ds)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fromr = (Window.partitionBy(cols.id, "_blk").orderBy(F.col(cols.ds).desc())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nxt = F.coalesce(F.lead(cols.ds).over(w), F.col("_next_min"))
    is_first = (F.row_number().over(w) == 1) & F.col("_first_blk")
    carried = {f"_c_{c}": F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_prev_{c}"),
                                     F.last(c, ignorenulls=True).over(fromr), F.col(f"_next_{c}"))
               for c in carry_cols}
    return j, nxt, is_first, carried


def fill_grid(df: DataFrame, cols: Cols = DEFAULT, freq: str = "D",
              start: str = "per_serie", end: str = "per_serie",
              zero_cols: list[str] | None = None, carry_cols: list[str] | None = None,
              bounds_from: DataFrame | None = None, block_size: int | None = None) -> DataFrame:
    """Reindex every series onto a regular grid of step ``freq``.

    ``start``/``end``: ``"per_serie"`` (J10: the series' own first/last
    stamp), ``"global"`` (J9, J11: over all rows of ``bounds_from``, default
    ``df``) or a literal timestamp string (rows outside are dropped). Input
    stamps must lie on the grid and be unique per series: a repeated or off-grid
    stamp stops the job with an error that names the series.
    ``block_size`` evaluates the neighbour lookups on time blocks
    (``_blocked_neighbours``) so that no series is confined to one task.
    """
    zero_cols, carry_cols = list(zero_cols or []), list(carry_cols or [])
    src = bounds_from if bounds_from is not None else df
    lo, hi = _bounds(src, cols.ds, start, end)
    if start not in ("per_serie", "global"):
        df = df.filter(F.col(cols.ds) >= lo)
    if end not in ("per_serie", "global"):
        df = df.filter(F.col(cols.ds) <= hi)

    if block_size:
        owned_src, nxt, is_first, carried = _blocked_neighbours(df, cols, freq, block_size, carry_cols)
    else:
        owned_src = df
        w = Window.partitionBy(cols.id).orderBy(cols.ds)
        nxt = F.lead(cols.ds).over(w)
        is_first = F.row_number().over(w) == 1
        carried = {f"_c_{c}": ffill_bfill(c, cols.id, cols.ds) for c in carry_cols}
    nxt = _on_grid(nxt, cols, freq)
    own_start = F.col(cols.ds) if lo is None else F.when(is_first, F.least(lo, F.col(cols.ds))).otherwise(F.col(cols.ds))
    own_end = F.coalesce(nxt - interval(freq), F.col(cols.ds) if hi is None else F.greatest(hi, F.col(cols.ds)))
    owned = owned_src.select(*df.columns, F.sequence(own_start, own_end, interval(freq)).alias("_pts"), *[
        v.alias(k) for k, v in carried.items()])
    # never empty; the outer form keeps Catalyst from evaluating the sequence twice for a size filter
    out = owned.select("*", F.explode_outer("_pts").alias("_g"))
    observed = F.col("_g") == F.col(cols.ds)
    others = [c for c in df.columns if c not in (cols.id, cols.ds)]
    proj = [F.col(cols.id), F.col("_g").alias(cols.ds)]
    for c in others:
        if c in zero_cols:
            zero = F.lit(0).cast(df.schema[c].dataType)
            proj.append(F.when(observed, F.coalesce(F.col(c), zero)).otherwise(zero).alias(c))
        elif c in carry_cols:
            proj.append(F.col(f"_c_{c}").alias(c))
        else:
            proj.append(F.when(observed, F.col(c)).alias(c))
    return out.select(*proj)


def horizon_grid(last: DataFrame, h: int, freq: str, cols: Cols = DEFAULT,
                 last_col: str = "_last_ds") -> DataFrame:
    """Series x horizon steps ``k = 1..h`` with ``ds = last + k*freq``.

    Generated per series row (``explode(sequence(1, h))``), never as a join
    of all series with all steps.
    """
    return (last.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(h))))
            .withColumn(cols.ds, step_forward(F.col(last_col), F.col("k"), freq)))
