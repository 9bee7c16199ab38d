"""Sources: table scans and CSV sets."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one Parquet table (S2). Projection and filters push into the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Tables:
    """Lazy, cached-by-name access to the tables of one directory (S3)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = read_table(self.spark, self.sf_dir, name)
        return self._frames[name]

    def rows(self, name: str) -> int:
        """Number of rows of a table, from the files' own counts."""
        if name not in self._rows:
            self._rows[name] = self[name].count()
        return self._rows[name]


def read_csv_set(spark: SparkSession, paths: dict[str, str],
                 schemas: dict[str, StructType] | None = None) -> dict[str, DataFrame]:
    """Read a named set of CSV files with explicit schemas.

    No schema inference: on 100 TB an inference pass is a full extra scan.
    Row counts are not computed here; call ``table_profile`` when wanted.
    """
    schemas = schemas or {}
    out = {}
    for name, path in paths.items():
        reader = spark.read.option("header", True)
        reader = reader.schema(schemas[name]) if name in schemas else reader.option("inferSchema", False)
        out[name] = reader.csv(path)
    return out


def table_profile(frames: dict[str, DataFrame]) -> DataFrame:
    """Row count and column list per named frame, as one DataFrame (S1 report)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(name).alias("table"), "n_rows",
                     F.lit(", ".join(df.columns)).alias("columns"))
             for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def head(df: DataFrame, n: int, *order_by: str) -> DataFrame:
    """First ``n`` rows by key order (S11 ``head``): a top-k, not a scan of all."""
    return df.orderBy(*order_by).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows chosen by a seeded hash of the key (S11 ``sample``).

    Reproducible under any partitioning, unlike ``orderBy(rand())``.
    """
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)
