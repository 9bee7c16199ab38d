"""Relational enrichment and aggregates.

Money is summed as ``decimal`` and turned into a double once, so results do
not depend on the order in which partitions are combined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesspark.functions.frequency import month_start


def exact_sum(col: str | Column, scale: int = 4) -> Column:
    """Order-independent sum of a fixed-place measure, returned as double."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double")


def exact_avg(col: str | Column, scale: int = 4) -> Column:
    """Mean as exact decimal sum divided once by the non-null count."""
    c = F.col(col) if isinstance(col, str) else col
    return exact_sum(c, scale) / F.count(c)


def enrich_items(items: DataFrame, orders: DataFrame, payments: DataFrame,
                 reviews: DataFrame, products: DataFrame | None = None,
                 sellers: DataFrame | None = None, customers: DataFrame | None = None,
                 delivered_status: str | None = "F") -> DataFrame:
    """Denormalised item fact.

    * payments and reviews are aggregated per order before the left join
      (D1, D2), so the join cannot fan out;
    * dimension joins are only made for the frames passed in: Catalyst cannot
      drop a left join to a dimension whose key is not known to be unique;
    * the delivered filter is written after the joins and is pushed by
      Catalyst into the ``orders`` scan.

    Large sides are not broadcast by hint: AQE converts a join to a broadcast
    only when the runtime size of a side is under the broadcast threshold.
    """
    pay = payments.groupBy("order_id").agg(exact_sum("payment_value").alias("payment_value"))
    rev = reviews.groupBy("order_id").agg(F.avg("review_score").alias("review_score"))
    out = (items.withColumn("item_total", F.col("price") + F.col("freight_value"))
           .join(orders, "order_id", "inner")
           .join(pay, "order_id", "left")
           .join(rev, "order_id", "left"))
    if products is not None:
        out = out.join(products, "product_id", "left")
    if sellers is not None:
        out = out.join(sellers, "seller_id", "left")
    if customers is not None:
        out = out.join(customers, "customer_id", "left")
    if delivered_status is not None:
        out = out.filter(F.col("order_status") == delivered_status)
    secs = F.expr("timestampdiff(SECOND, order_purchase_timestamp, order_delivered_customer_date)")
    return (out.withColumn("delivery_secs", secs)
            .withColumn("delivery_days", secs / F.lit(86400.0))
            .withColumn("month", month_start("order_purchase_timestamp")))


def _delivery_days_avg() -> Column:
    return F.sum("delivery_secs").cast("double") / F.count("delivery_secs") / F.lit(86400.0)


def monthly_series(enriched: DataFrame) -> DataFrame:
    """Single monthly series with eight measures (D3).

    ``delivered_count`` counts order items, as the reference does.
    """
    return (enriched.filter(F.col("month").isNotNull())
            .groupBy("month")
            .agg(exact_sum("item_total").alias("total_delivered_value"),
                 F.countDistinct("order_id").alias("new_orders_created"),
                 F.count("order_id").alias("delivered_count"),
                 F.round(_delivery_days_avg(), 6).alias("avg_delivery_days"),
                 F.round(F.avg("review_score"), 6).alias("avg_review_score"),
                 F.countDistinct("seller_id").alias("n_unique_sellers"),
                 F.countDistinct("product_id").alias("n_unique_products"),
                 F.round(exact_avg("freight_value"), 6).alias("avg_freight")))


SELLER_SUM_COLS = ["revenue", "order_count", "item_count", "n_unique_products", "n_unique_customers"]
SELLER_AVG_COLS = ["avg_price", "avg_freight", "avg_delivery_days", "avg_review_score"]


def seller_monthly_raw(enriched: DataFrame, id_col: str = "seller_id") -> DataFrame:
    """Per-seller monthly aggregate on the ungridded rows.

    The facts are read once and shuffled once, by (seller, month). Within that
    partitioning the first row of each order, product and customer of a group is
    flagged (three in-partition sorts that spill), so the three distinct counts are
    plain sums of flags: no Expand that copies the facts per distinct count, and
    no second aggregate over the same facts.
    """
    keys = [id_col, "month"]
    base = (enriched.filter(F.col(id_col).isNotNull() & F.col("month").isNotNull())
            .select(*keys, "order_id", "product_id", "customer_id", "item_total", "price", "freight_value",
                    "delivery_secs", "review_score")
            .repartition(*keys))

    def first_of(col: str) -> Column:
        nth = F.row_number().over(Window.partitionBy(*keys, col).orderBy(col))
        return F.when(F.col(col).isNotNull() & (nth == 1), 1).otherwise(0)

    flagged = base.withColumn("_o", first_of("order_id")).withColumn("_p", first_of("product_id")) \
        .withColumn("_c", first_of("customer_id"))
    return flagged.groupBy(*keys).agg(
        exact_sum("item_total").alias("revenue"),
        F.sum("_o").alias("order_count"),
        F.count("order_id").alias("item_count"),
        F.round(exact_avg("price", 2), 6).alias("avg_price"),
        F.round(exact_avg("freight_value"), 6).alias("avg_freight"),
        F.round(_delivery_days_avg(), 6).alias("avg_delivery_days"),
        F.round(F.avg("review_score"), 6).alias("avg_review_score"),
        F.sum("_p").alias("n_unique_products"),
        F.sum("_c").alias("n_unique_customers"))


def keep_active(raw: DataFrame, id_col: str, min_periods: int) -> DataFrame:
    """Keep series with at least ``min_periods`` ungridded rows (D5 + J5).

    Written as a count over the series partition: the semi-join needs no
    extra shuffle because the grid fill that follows is partitioned by the
    same key.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    return raw.withColumn("_n_active", n).filter(F.col("_n_active") >= min_periods).drop("_n_active")


def semi_join(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``."""
    return df.join(keys, on, "left_semi")


def anti_join(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` not in ``other``."""
    return df.join(other, on, "left_anti")


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all shared column names."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how)


def union_labelled(frames: dict[str, DataFrame], label_col: str) -> DataFrame:
    """Union all of frames, each tagged with its label."""
    tagged = [df.withColumn(label_col, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def top_groups(df: DataFrame, id_col: str, value_col: str, k: int) -> DataFrame:
    """Top ``k`` series by total of ``value_col``, ties by id.

    Partial aggregation runs before the shuffle; the top-k keeps ``k`` rows
    per partition before the final merge (TakeOrderedAndProject).
    """
    return (df.groupBy(id_col).agg(F.sum(value_col).alias("total"))
            .orderBy(F.desc("total"), F.asc(id_col)).limit(k))


def top_abs(df: DataFrame, value_col: str, k: int, *tie_cols: str) -> DataFrame:
    """Top ``k`` rows by absolute value (T4)."""
    return df.orderBy(F.desc(F.abs(F.col(value_col))), *tie_cols).limit(k)


def first_ids(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """First ``n`` series ids in key order."""
    return df.select(id_col).distinct().orderBy(id_col).limit(n)


def sample_ids(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` distinct ids ranked by a seeded hash (T3): reproducible in any engine."""
    ids = df.select(id_col).distinct()
    return (ids.withColumn("_h", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}"))))
            .orderBy("_h", id_col).limit(n).drop("_h"))
