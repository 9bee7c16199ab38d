import os
import tempfile

from pyspark.sql import functions as F

from seriesspark.sources.sinks import log_metrics, write_artifact
from seriesspark.sources.tables import read_csv_set, table_profile
from seriesspark.streaming.panel_stream import ten_minute_stream


def test_csv_set_and_profile(spark):
    d = tempfile.mkdtemp(prefix="ss-csv-")
    p = os.path.join(d, "a.csv")
    with open(p, "w") as f:
        f.write("order_id,payment_value\no1,1.5\no1,2.0\no2,3.0\n")
    frames = read_csv_set(spark, {"payments": p}, {"payments": "order_id string, payment_value double"})
    prof = table_profile(frames).collect()[0]
    assert prof.n_rows == 3 and prof.columns == "order_id, payment_value"


def test_artifacts_and_metrics(spark):
    run = tempfile.mkdtemp(prefix="ss-run-")
    m = spark.createDataFrame([(1.0, 2.0, 5)], "mae double, rmse double, n_series long")
    log_metrics(m, run, "r1", "univariate")
    log_metrics(m, run, "r2", "covariate")
    got = spark.read.parquet(os.path.join(run, "metrics"))
    assert got.count() == 6
    assert got.filter(F.col("metric") == "covariate_mae").count() == 1
    path = write_artifact(m, run, "train.parquet")
    assert spark.read.parquet(path).count() == 1


def test_streaming_panel_matches_batch(spark):
    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    stream = (spark.readStream.schema(schema).format("parquet")
              .option("pathGlobFilter", "events.parquet").load(os.path.dirname(src)))
    q = (ten_minute_stream(stream).writeStream.outputMode("complete").format("memory")
         .queryName("ss_panel_stream").start())
    q.processAllAvailable()
    q.stop()
    n = spark.sql("SELECT count(*) AS c FROM ss_panel_stream").collect()[0].c
    from seriesspark.sources import bindings as b
    from seriesspark.sources.tables import Tables
    assert n == b.ten_minute_panel(Tables(spark, "/root/testdata/sf0.001")).count()
