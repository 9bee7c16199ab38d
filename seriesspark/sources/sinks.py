"""Sinks: namespaces, views, table replacement, run artifacts.

The table format is a parameter (Parquet by default; Delta is not installed
here). Writes go to paths under a shared folder, never to a machine-local
directory on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create_schema(spark: SparkSession, name: str) -> None:
    """``CREATE SCHEMA IF NOT EXISTS``."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}`")


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Register a result as a temporary view."""
    df.createOrReplaceTempView(name)
    return df


def replace_table(df: DataFrame, name: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                  path: str | None = None) -> None:
    """Replace a table with a query result (S6, S7): a managed one, or an external one at ``path``."""
    w = df.write.mode("overwrite").format(fmt)
    if path:
        w = w.option("path", path)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def write_artifact(df: DataFrame, run_path: str, name: str, fmt: str = "parquet") -> str:
    """Persist a frame (train/test/metrics) under a run folder."""
    path = f"{run_path.rstrip('/')}/{name}"
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def log_metrics(metrics: DataFrame, run_path: str, run_id: str, prefix: str) -> str:
    """Append ``(run, metric, value)`` rows for every numeric column.

    Metric names are ``{prefix}_{column}`` as in the reference's logging.
    """
    num = [f.name for f in metrics.schema.fields if f.dataType.typeName() in ("double", "long", "integer", "float")]
    stack = ", ".join(f"'{prefix}_{c}', CAST(`{c}` AS DOUBLE)" for c in num)
    rows = metrics.selectExpr(f"stack({len(num)}, {stack}) AS (metric, value)").withColumn("run", F.lit(run_id))
    path = f"{run_path.rstrip('/')}/metrics"
    rows.write.mode("append").parquet(path)
    return path
