"""Helpers shared by the training-data operators.

* ``scratch`` / ``materialize``: tables in the folder that ``spark.checkpoint.dir``
  names, so a lost executor re-reads them instead of recomputing its lineage.
* ``running_totals``: a global running sum over an order without one task seeing
  all rows (range partitions, one total per partition, then local prefixes).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesspark.session import checkpoint_dir

# A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a directory, through Spark's reader (any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared scratch table and read it back (lineage ends there)."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also fold other scripts)."""
    return F.translate(c, UPPER, LOWER)


def count_chars(c: Column, char_class: str) -> Column:
    """Code points of ``c`` that lie in a regex character class, e.g. ``#*$``."""
    return F.length(F.regexp_replace(c, f"[^{char_class}]+", "")).cast("long")


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column],
                   by: list[str] | None = None, name: str = "order") -> DataFrame:
    """Add, for each ``sums`` entry, the sum over all earlier rows (exclusive) of the order.

    ``by`` restarts the sums per group; ``order`` must then begin with the group
    columns. Rows are range-partitioned by the order and written once, so the
    partition a row belongs to is fixed. A group of any size is spread over the
    partitions its order range covers; what meets in one task is one total per
    partition (and group), never the rows. Ties in the order get an arbitrary
    but fixed relative position. An empty input gives an empty result.
    """
    by = by or []
    n = partitions(df.sparkSession)
    cols = list(sums)
    t = df.withColumns({f"_add_{c}": v for c, v in sums.items()})
    t = t.repartitionByRange(n, *order).withColumn("_blk", F.spark_partition_id())
    t = materialize(t, name)
    totals = t.groupBy(*by, "_blk").agg(*[F.sum(f"_add_{c}").alias(f"_tot_{c}") for c in cols])
    before = (Window.partitionBy(*by) if by else Window).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_blk").alias("_b"),
                            *[F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in cols])
    local = Window.partitionBy(*by, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({c: F.coalesce(F.sum(f"_add_{c}").over(local), F.lit(0)) for c in cols})
    on = t["_blk"] == offsets["_b"]
    for b in by:
        on = on & t[b].eqNullSafe(offsets[f"_by_{b}"])
    t = t.join(offsets, on, "left")
    t = t.withColumns({c: F.col(c) + F.col(f"_off_{c}") for c in cols})
    return t.drop("_blk", "_b", *[f"_by_{b}" for b in by],
                  *[p + c for c in cols for p in ("_add_", "_off_")])
