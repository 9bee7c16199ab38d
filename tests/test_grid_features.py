import datetime as dt

from pyspark.sql import functions as F

from seriesspark.functions.contracts import Cols, PanelError, validate_panel
from seriesspark.operators.features import ExpandingMean, RollingMean, lag_features
from seriesspark.operators.grid import fill_grid

D = dt.datetime


def panel(spark, rows):
    return spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")


def test_fill_grid_zero_and_carry(spark):
    rows = [("a", D(2024, 1, 1), None), ("a", D(2024, 1, 3), 3.0), ("a", D(2024, 1, 6), 6.0),
            ("b", D(2024, 1, 2), 2.0), ("b", D(2024, 1, 4), None)]
    df = panel(spark, rows).withColumn("z", F.col("y"))
    out = fill_grid(df, Cols(), "D", start="global", end="global", zero_cols=["z"], carry_cols=["y"])
    got = {(r.unique_id, r.ds.day): (r.y, r.z) for r in out.collect()}
    assert len(got) == 12
    # leading NULL is back-filled, gaps forward-filled, additive column zero
    assert got[("a", 1)] == (3.0, 0.0)
    assert got[("a", 2)] == (3.0, 0.0)
    assert got[("a", 4)] == (3.0, 0.0)
    assert got[("a", 6)] == (6.0, 6.0)
    assert got[("b", 1)] == (2.0, 0.0)
    assert got[("b", 6)] == (2.0, 0.0)


def test_fill_grid_idempotent(spark):
    rows = [("a", D(2024, 1, d), float(d)) for d in (1, 2, 5, 9)]
    once = fill_grid(panel(spark, rows), Cols(), "D", carry_cols=["y"])
    twice = fill_grid(once, Cols(), "D", carry_cols=["y"])
    assert sorted(once.collect()) == sorted(twice.collect())


def test_validate_panel_duplicates(spark):
    rows = [("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 1), 2.0), ("a", D(2024, 1, 2), 1.0)]
    try:
        validate_panel(panel(spark, rows))
    except PanelError:
        return
    raise AssertionError("duplicate (id, ds) not detected")


def test_lag_features_known_values_and_no_leak(spark):
    rows = [("a", D(2024, 1, 1) + dt.timedelta(days=i), float(i + 1)) for i in range(10)]
    df = panel(spark, rows)
    feats = lag_features(df, lags=[1, 2], lag_transforms={1: [ExpandingMean()], 2: [RollingMean(3)]})
    got = {r.ds.day: r for r in feats.collect()}
    # first complete row: rolling mean of lag 2 window 3 needs t-4..t-2
    assert min(got) == 5
    r = got[5]
    assert (r.lag1, r.lag2) == (4.0, 3.0)
    assert r.expanding_mean_lag1 == 2.5
    assert r.rolling_mean_lag2_window_size3 == 2.0
    # changing the future must not change features of earlier rows
    fut = df.withColumn("y", F.when(F.dayofmonth("ds") >= 8, F.lit(1000.0)).otherwise(F.col("y")))
    feats2 = {r.ds.day: r for r in lag_features(fut, lags=[1, 2], lag_transforms={
        1: [ExpandingMean()], 2: [RollingMean(3)]}).collect()}
    for day in (5, 6, 7, 8):
        a, b = got[day].asDict(), feats2[day].asDict()
        a.pop("y"), b.pop("y")
        assert a == b


def test_blocked_features_equal_plain_with_hot_series(spark):
    import random
    rnd = random.Random(5)
    rows = [("hot", D(2020, 1, 1) + dt.timedelta(days=i), float(rnd.randint(0, 9))) for i in range(900)]
    rows += [(f"s{k}", D(2022, 1, 1) + dt.timedelta(days=i), float(rnd.randint(0, 9)))
             for k in range(3) for i in range(40)]
    df = panel(spark, rows)
    spec = dict(lags=[1, 7], lag_transforms={1: [ExpandingMean()], 7: [RollingMean(5)]},
                differences=[1], date_features=["quarter"])
    plain = lag_features(df, **spec)
    blocked = lag_features(df, **spec, block_size=64, freq="D")
    assert plain.count() == blocked.count() > 0
    assert plain.exceptAll(blocked).count() == 0 and blocked.exceptAll(plain).count() == 0


def test_blocked_fill_grid_equal_plain(spark):
    rows = [("a", D(2024, 1, 1), None), ("a", D(2024, 1, 3), 3.0), ("a", D(2024, 1, 19), None),
            ("a", D(2024, 2, 20), 6.0), ("b", D(2024, 1, 9), None), ("b", D(2024, 1, 30), 1.0)]
    df = panel(spark, rows).withColumn("z", F.col("y"))
    for kw in (dict(carry_cols=["y"], zero_cols=["z"]),
               dict(start="global", end="global", carry_cols=["y"], zero_cols=["z"])):
        plain = fill_grid(df, Cols(), "D", **kw)
        blocked = fill_grid(df, Cols(), "D", block_size=7, **kw)
        assert plain.count() == blocked.count()
        assert plain.exceptAll(blocked).count() == 0


def test_fill_grid_names_the_series_with_a_bad_stamp(spark):
    import datetime as dt

    import pytest

    from seriesspark.operators.grid import fill_grid
    day = dt.datetime(2024, 1, 1)
    for second in (day, day + dt.timedelta(days=1, hours=3)):
        df = spark.createDataFrame([("bad one", day, 1.0), ("bad one", second, 2.0)], "unique_id string, ds timestamp_ntz, y double")
        with pytest.raises(Exception, match="series bad one"):
            fill_grid(df, freq="D").collect()
