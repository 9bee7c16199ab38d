import datetime as dt
import math

import numpy as np
from dense import arima
from pyspark.sql import functions as F

from seriesspark.operators.analysis import acf, pacf, seasonal_decompose
from seriesspark.operators.hierarchy import bottom_up, build_hierarchy, coherence_gap, mint_reconcile, shrinkage

D = dt.datetime


def test_decompose_exact_trend_and_season(spark):
    season = [1.0, -2.0, 0.5, 0.5]
    rows = [("a", D(2024, 1, 1) + dt.timedelta(days=t), 0.5 * t + season[t % 4]) for t in range(24)]
    df = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")
    out = seasonal_decompose(df, 4).orderBy("ds").collect()
    for i, r in enumerate(out):
        if r.trend is not None:
            assert abs(r.trend - 0.5 * i) < 1e-9
            assert abs(r.seasonal - season[i % 4]) < 1e-9
            assert abs(r.resid) < 1e-9


def test_acf_brute_force_and_pacf_ar1(spark):
    rng = np.random.default_rng(7)
    y = np.zeros(2000)
    for t in range(1, 2000):
        y[t] = 0.7 * y[t - 1] + rng.normal()
    rows = [("a", D(2020, 1, 1) + dt.timedelta(hours=t), float(v)) for t, v in enumerate(y)]
    df = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")
    a = {r.lag: r.acf for r in acf(df, 3).collect()}
    d = y - y.mean()
    for k in (1, 2, 3):
        want = (d[k:] * d[:-k]).sum() / (2000 - k) / ((d * d).sum() / 2000)
        assert math.isclose(a[k], want, rel_tol=1e-9)
    p = {r.lag: r.pacf for r in pacf(df, 3).collect()}
    assert abs(p[1] - 0.7) < 0.05 and abs(p[2]) < 0.08


def _tree_panel(spark):
    rows, tree = [], [("b1", "R1", "N1"), ("b2", "R1", "N1"), ("b3", "R1", "N2"), ("b4", "R2", "N3")]
    rng = np.random.default_rng(1)
    for b, _, _ in tree:
        for t in range(30):
            rows.append((b, D(2024, 1, 1) + dt.timedelta(days=t), float(rng.integers(0, 10))))
    df = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")
    tr = spark.createDataFrame(tree, "unique_id string, region string, nation string")
    return df, tr


def test_hierarchy_bottom_up_coherent(spark):
    df, tr = _tree_panel(spark)
    Y, S = build_hierarchy(df, tr, ["region", "nation"])
    assert Y.select("unique_id").distinct().count() == 1 + 2 + 3 + 4
    assert S.count() == 4 * 4
    rec = bottom_up(df.withColumnRenamed("y", "yhat"), S, ["yhat"])
    gap = coherence_gap(rec, S, "yhat").collect()[0]
    assert gap.max_gap == 0.0 and gap.n_checked == 10 * 30


def test_mint_against_dense_algebra(spark):
    rng = np.random.default_rng(5)
    bottoms, T = ["b1", "b2", "b3", "b4"], 40
    tree = {"total": bottoms, "R1": bottoms[:3], "R1/N1": bottoms[:2]}
    nodes = [*tree, *bottoms]
    X = rng.normal(size=(T, len(nodes))) + rng.normal(size=(T, 1))
    y = rng.normal(10, 3, size=(len(nodes), 2))
    day = lambda t: D(2024, 1, 1) + dt.timedelta(days=t)
    resid = spark.createDataFrame([(n, day(t), float(X[t, i])) for i, n in enumerate(nodes) for t in range(T)], "unique_id string, ds timestamp_ntz, resid double")
    base = spark.createDataFrame([(n, day(100 + k), float(y[i, k])) for i, n in enumerate(nodes) for k in range(2)], "unique_id string, ds timestamp_ntz, yhat double")
    S = spark.createDataFrame([(a, b, 1.0) for a, bs in [*tree.items(), *[(b, [b]) for b in bottoms]] for b in bs], "node string, bottom string, weight double")
    # the shrinkage covariance and the projection, dense
    Xc = X - X.mean(axis=0)
    cov = Xc.T @ Xc / (T - 1)
    Z = Xc / X.std(axis=0, ddof=1)
    w, w2 = Z.T @ Z, (Z * Z).T @ (Z * Z)
    off = ~np.eye(len(nodes), dtype=bool)
    lam = np.clip((T / (T - 1) ** 3 * (w2 - w ** 2 / T))[off].sum() / ((w / (T - 1)) ** 2)[off].sum(), 0, 1)
    assert abs(shrinkage(resid) - lam) < 1e-9
    W = lam * np.diag(np.diag(cov)) + (1 - lam) * cov
    Sm = np.array([[1.0 if b in tree.get(n, [n]) else 0.0 for b in bottoms] for n in nodes])
    Wi = np.linalg.inv(W)
    want = Sm @ np.linalg.solve(Sm.T @ Wi @ Sm, Sm.T @ Wi @ y)
    rec = mint_reconcile(base, resid, S, ["yhat"])
    got = {(r.unique_id, r.ds): r.yhat for r in rec.collect()}
    for i, n in enumerate(nodes):
        for k in range(2):
            assert abs(got[n, day(100 + k)] - want[i, k]) < 1e-6
    gap = coherence_gap(rec, S, "yhat").collect()[0]
    assert gap.max_gap < 1e-6 and gap.n_checked == 14


def test_arima_tracks_ar1():
    rng = np.random.default_rng(3)
    y = np.zeros(500)
    for t in range(1, 500):
        y[t] = 0.7 * y[t - 1] + rng.normal()
    fc = arima(y, (1, 0, 0), 2)
    assert abs(fc[0] - 0.7 * y[-1]) < 0.3


def test_blocked_acf_and_decompose_equal_plain(spark):
    rng = np.random.default_rng(9)
    rows = [(i, D(2024, 1, 1) + dt.timedelta(hours=t), float(np.sin(t / 3.0) * 5 + rng.integers(0, 3)))
            for i, n in (("hot", 400), ("b", 60)) for t in range(n)]
    df = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")
    a = {(r.unique_id, r.lag): r.acf for r in acf(df, 5).collect()}
    b = {(r.unique_id, r.lag): r.acf for r in acf(df, 5, block_size=24, freq="H").collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[x], b[x], rel_tol=1e-9, abs_tol=1e-12) for x in a)
    p = {(r.unique_id, r.ds): r for r in seasonal_decompose(df, 12).collect()}
    q = {(r.unique_id, r.ds): r for r in seasonal_decompose(df, 12, block_size=24, freq="H").collect()}
    assert p.keys() == q.keys()
    for key_, r in p.items():
        for c in ("trend", "seasonal", "resid"):
            x, y_ = r[c], q[key_][c]
            assert (x is None and y_ is None) or math.isclose(x, y_, rel_tol=1e-9, abs_tol=1e-9)


def test_exact_quantiles_match_percentile_on_hot_group(spark):
    from seriesspark.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(2)
    rows = [("hot", float(x)) for x in rng.normal(size=30000).round(2)]
    rows += [("small", float(x)) for x in (1.0, 4.0, 4.0, 9.0)] + [("one", 2.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.05, 0.5, 0.95]
    want = {}
    for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(q) for q in qs])).alias("p")).collect():
        for i, q in enumerate(qs):
            want[(r.g, q)] = r.p[i]
    for acc in (100, 10000):  # bracket path for the hot group, then whole-group ranking
        got = {(r.g, r.q): r.quantile for r in exact_quantiles(df, ["g"], "v", qs, accuracy=acc).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in want)


def test_correlation_of_many_series_and_quoted_ids(spark):
    import datetime as dt

    import numpy as np

    from seriesspark.operators.analysis import corr_matrix, top_correlations
    rng = np.random.default_rng(2)
    names = [f"s{i:03d}" for i in range(299)] + ["o'a"]
    data = rng.normal(size=(12, 300))
    rows = [(n, dt.datetime(2024, 1, 1) + dt.timedelta(days=t), float(data[t, i])) for i, n in enumerate(names) for t in range(12)]
    df = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")
    got = {(r.target, r.unique_id): r["corr"] for r in corr_matrix(df).collect()}
    want = np.corrcoef(data.T)
    assert len(got) == 300 * 300
    for i, j in ((0, 1), (299, 5), (150, 299), (7, 7)):
        assert abs(got[names[i], names[j]] - want[i, j]) < 1e-9
    top = top_correlations(df, "o'a", 1).collect()
    assert top[0].unique_id == "o'a" and abs(top[0]["corr"] - 1) < 1e-9
