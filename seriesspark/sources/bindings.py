"""Binding of the reference's data roles to the driver's tables.

Each function maps raw tables to one role of the long-table contract:

* orders: ``orders`` (delivered = status ``F``), bought at ``o_orderdate``.
* items: ``lineitem`` rows; seller ``l_suppkey``, product ``l_partkey``,
  price ``l_extendedprice``, freight ``l_extendedprice * l_tax`` (4 places),
  delivered at ``l_shipdate``.
* payments: ``l_extendedprice * (1 - l_discount)`` per item row.
* reviews: the digit of ``o_orderpriority`` (1-5), one per order.
* products/categories: ``part.p_type``; seller/customer state: nation name.
* daily panel: ``sum(l_quantity)`` by ``(l_suppkey, l_shipdate)``.
* 10-minute panel: ``avg(value)`` of ``events`` by type and 10-minute bucket.
* hierarchy: total / region / nation / supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesspark.functions.frequency import bucket_timestamp


def items(t) -> DataFrame:
    li = t["lineitem"]
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        F.round(F.col("l_extendedprice") * F.col("l_tax"), 4).alias("freight_value"),
        F.col("l_shipdate").alias("order_delivered_customer_date"),
    )


def orders(t) -> DataFrame:
    o = t["orders"]
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
    )


def payments(t) -> DataFrame:
    li = t["lineitem"]
    return li.select(F.col("l_orderkey").alias("order_id"),
                     F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
                     .alias("payment_value"))


def reviews(t) -> DataFrame:
    o = t["orders"]
    return o.select(F.col("o_orderkey").alias("order_id"),
                    F.substring("o_orderpriority", 1, 1).cast("int").alias("review_score"))


def products(t) -> DataFrame:
    return t["part"].select(F.col("p_partkey").alias("product_id"),
                            F.col("p_type").alias("product_category_name"))


def sellers(t) -> DataFrame:
    return (t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state")))


def customers(t) -> DataFrame:
    return (t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("customer_state")))


def daily_panel(t) -> DataFrame:
    """Sparse daily panel ``(unique_id, ds, y)``: one series per supplier."""
    return (t["lineitem"]
            .groupBy(F.col("l_suppkey").cast("string").alias("unique_id"),
                     F.col("l_shipdate").alias("ds"))
            .agg(F.sum("l_quantity").alias("y")))


ITEM_ROWS, SERIES = 250_000, 400  # item rows, and suppliers, of one partition of the filled daily panel


def daily_partitions(t) -> int:
    """Partitions of the filled daily panel: they grow with the items and the suppliers (row counts of the files)."""
    return max(t.spark.sparkContext.defaultParallelism, -(-t.rows("lineitem") // ITEM_ROWS), -(-t.rows("supplier") // SERIES))


def ten_minute_panel(t) -> DataFrame:
    """Sparse 10-minute panel: one series per event type.

    ``y`` is the bucket mean computed in decimal (exact sum of 2-place
    values, one division) and kept to 4 places (half up), so every engine and
    every partitioning produce the same value.
    """
    ev = t["events"]
    mean = F.sum(F.col("value").cast("decimal(18,2)")) / F.count("value")
    return (ev.groupBy(F.col("event_type").alias("unique_id"),
                       bucket_timestamp("ts", "10min").alias("ds"))
            .agg(mean.cast("decimal(18,4)").cast("double").alias("y")))


def supplier_tree(t) -> DataFrame:
    """Bottom series with their ancestors: ``(unique_id, region, nation)``."""
    return (t["supplier"]
            .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
            .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").cast("string").alias("unique_id"),
                    F.col("r_name").alias("region"), F.col("n_name").alias("nation")))


def static_attributes(t) -> DataFrame:
    """Per-series static attributes (nation and region of the supplier)."""
    return supplier_tree(t).select("unique_id", F.col("nation").alias("state_id"),
                                   F.col("region").alias("cat_id"))
