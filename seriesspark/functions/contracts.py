"""Column-name contract of the long series table and panel validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cols:
    """Names of the id, time and target columns (all operators take one)."""

    id: str = "unique_id"
    ds: str = "ds"
    y: str = "y"


DEFAULT = Cols()


class PanelError(ValueError):
    pass


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN becomes SQL NULL at ingest; no NaN leaves an operator."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


def panel_violations(df: DataFrame, cols: Cols = DEFAULT) -> DataFrame:
    """One row per series with duplicate timestamps or more than one step size.

    A single distributed aggregate; empty result means the panel is valid.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(cols.id).orderBy(cols.ds)
    steps = (df.select(cols.id, cols.ds)
             .withColumn("_step", F.col(cols.ds).cast("timestamp").cast("double")
                         - F.lag(F.col(cols.ds).cast("timestamp").cast("double")).over(w)))
    return (steps.groupBy(cols.id)
            .agg(F.sum(F.when(F.col("_step") == 0, 1).otherwise(0)).alias("n_duplicates"),
                 F.countDistinct(F.when(F.col("_step") > 0, F.col("_step"))).alias("n_step_sizes"))
            .filter((F.col("n_duplicates") > 0) | (F.col("n_step_sizes") > 1)))


def validate_panel(df: DataFrame, cols: Cols = DEFAULT, allow_irregular: bool = False) -> DataFrame:
    """Raise ``PanelError`` on duplicate ``(id, ds)``; optionally on irregular steps.

    This is an action (one aggregate, only the count reaches the driver).
    Month-start panels have varying second counts per step, so callers with
    ``MS`` data pass ``allow_irregular=True``.
    """
    bad = panel_violations(df, cols)
    if allow_irregular:
        bad = bad.filter(F.col("n_duplicates") > 0)
    first = bad.limit(1).collect()
    if first:
        raise PanelError(f"panel invalid for series {first[0][cols.id]!r}: {first[0].asDict()}")
    return df
