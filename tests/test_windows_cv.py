import datetime as dt

from seriesspark.functions.contracts import Cols
from seriesspark.operators.forecast import closed_form_forecast, cross_validation
from seriesspark.operators.features import difference, undifference
from seriesspark.operators.windows import window_arrays, window_count

D = dt.datetime


def series(spark, n, ids=("a",), start=D(2024, 1, 1)):
    rows = [(i, start + dt.timedelta(days=t), float(t + 1) * (1 + k)) for k, i in enumerate(ids) for t in range(n)]
    return spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")


def test_window_count_formula():
    assert window_count(30, 10, 5, 1) == 16
    assert window_count(30, 10, 5, 3) == 6
    assert window_count(14, 10, 5, 1) == 0
    assert window_count(15, 10, 5, 1) == 1
    assert window_count(30, 10, 5, 1, legacy=True) == 15  # reference drops one window


def test_window_arrays_brute_force(spark):
    n, L, H = 30, 10, 5
    for step in (1, 3):
        df = series(spark, n, ("a", "b"))
        got = sorted((r.unique_id, r.cutoff.day, tuple(r.input), tuple(r.output))
                     for r in window_arrays(df, L, H, step, element_type="double").collect())
        want = []
        for k, i in enumerate(("a", "b")):
            y = [float(t + 1) * (1 + k) for t in range(n)]
            for c in range(L, n - H + 1):
                if (n - H - c) % step == 0:
                    want.append((i, c, tuple(y[c - L:c]), tuple(y[c:c + H])))
        assert got == sorted(want)
        assert len(got) == 2 * window_count(n, L, H, step)


def test_cv_naive_two_series_share_cutoff(spark):
    df = series(spark, 20, ("a", "b"))
    cv = cross_validation(df, 2, 3, "D", None, ("Naive",), 1).collect()
    assert len(cv) == 2 * 3 * 2
    for r in cv:
        # naive forecast equals the value at the cutoff of the same series
        scale = 1 if r.unique_id == "a" else 2
        assert r.Naive == float(r.cutoff.day) * scale


def test_seasonal_naive_and_short_series(spark):
    rows = [("a", D(2024, 1, 1) + dt.timedelta(days=t), float(t % 4)) for t in range(12)]
    rows += [("short", D(2024, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")
    fc = {(r.unique_id, r.ds.day): r for r in
          closed_form_forecast(df, 6, "D", ("Naive", "SeasonalNaive"), 4, level=[80]).collect()}
    assert [fc[("a", 12 + k)].SeasonalNaive for k in range(1, 7)] == [0.0, 1.0, 2.0, 3.0, 0.0, 1.0]
    assert fc[("a", 13)].Naive == 3.0
    assert fc[("short", 2)].SeasonalNaive is None
    lo, hi = fc[("a", 13)]["Naive-lo-80"], fc[("a", 13)]["Naive-hi-80"]
    assert lo < 3.0 < hi


def test_difference_inverse_identity(spark):
    df = series(spark, 10)
    d = difference(df, Cols(), 1).filter("ds > timestamp_ntz'2024-01-05'")
    last = spark.createDataFrame([("a", 5.0)], "unique_id string, _last_level double")
    back = {r.ds.day: r.y for r in undifference(d, last).collect()}
    assert back == {day: float(day) for day in range(6, 11)}


def test_window_arrays_blocked_equal_plain(spark):
    df = series(spark, 200, ("a", "b", "c"))
    for step in (1, 4):
        plain = window_arrays(df, 20, 7, step, element_type="double")
        blocked = window_arrays(df, 20, 7, step, element_type="double", block_size=30, freq="D")
        assert plain.count() == blocked.count() == 3 * window_count(200, 20, 7, step)
        assert plain.exceptAll(blocked).count() == 0
