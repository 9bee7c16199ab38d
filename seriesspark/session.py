"""Session construction and cluster-safe lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this library relies on. Time zone is pinned so that
# timestamp_ntz arithmetic and the DuckDB oracle agree; AQE re-plans joins
# and coalesces shuffle partitions at runtime; skew-join splitting handles a
# hot series key holding a large share of rows.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "seriesspark", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's defaults.

    On a cluster, pass ``master=None`` so the launcher's master is used and
    size ``shuffle_partitions`` to the data (about 128 MB per partition).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """True when driver and executors are one process (``local`` masters)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only a local master,
    whose executors are the driver process, may do without it: then a folder
    under ``/tmp`` is used. Anywhere else an unset folder is an error, because
    files on one machine are lost to the others.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if conf_dir:
        if not current:
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    if current:
        return current
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = fallback or os.path.join("/tmp", "seriesspark-checkpoints")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python tasks import it by name, so a driver started from another folder, or
    a cluster without the package installed, needs it shipped.
    """
    sc = spark.sparkContext
    if getattr(sc, "_seriesspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="seriesspark-"), "seriesspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("seriesspark", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._seriesspark_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    """Number of partitions that the session deals a shuffle into when none is named."""
    conf = spark.conf
    adaptive = all(conf.get(k).lower() == "true" for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled"))
    initial = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) if adaptive else None
    return int(initial or conf.get("spark.sql.shuffle.partitions"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used by iterative operators (recursive forecasting) so a lost executor
    recomputes from the checkpoint, not from the start of the loop.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_once(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    For tables that several jobs read: lineage ends there as in ``cut_lineage``, and
    encoded columns take a fraction of a checkpoint's rows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/series-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
