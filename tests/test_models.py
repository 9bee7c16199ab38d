"""Per-series models as Spark expressions against dense versions, and models at rolling origins."""

import datetime as dt

import numpy as np
import pytest
from dense import arima as dense_arima
from dense import auto_arima as dense_auto
from dense import stl as dense_stl
from pyspark.sql import functions as F

from seriesspark.functions.contracts import DEFAULT
from seriesspark.operators import arima as ar
from seriesspark.operators import hierarchy, ml, smoothing
from seriesspark.operators.features import ExpandingMean, RollingMean, lag_features
from seriesspark.operators.forecast import short_series
from seriesspark.operators.stl import stl_features

START = dt.datetime(2024, 1, 1)


def panel(spark, series):
    rows = [(name, START + dt.timedelta(days=t), None if v is None else float(v)) for name, values in series.items() for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")


def by_series(frame, value="yhat"):
    out = {}
    for r in frame.orderBy("ds").collect():
        out.setdefault(r["unique_id"], []).append(r[value])
    return out


def walks(n, lengths=(60, 75, 90), seed=2):
    rng = np.random.default_rng(seed)
    return {f"s{i:02d}": np.round(np.cumsum(rng.normal(size=lengths[i % len(lengths)])) * (i + 1) + rng.normal(size=lengths[i % len(lengths)]), 3) for i in range(n)}


# --- ARIMA -------------------------------------------------------------------

@pytest.mark.parametrize("order", [(1, 1, 1), (2, 0, 1), (0, 2, 1), (3, 1, 0)])
def test_arima_equals_dense_least_squares(spark, order):
    data = walks(6) | {"short": [1.0, 4.0, 2.0], "middle": np.arange(16.0) ** 1.5}
    want = {k: dense_arima(np.asarray(v, float), order, 3) for k, v in data.items()}
    df = panel(spark, data)
    for frame in (ar.arima(df, order, 3, "D"), ar.arima(df, order, 3, "D", block_size=20)):
        got = by_series(frame)
        assert got.keys() == want.keys()
        for k in got:
            assert np.allclose(got[k], want[k], rtol=1e-6, atol=1e-6), (k, got[k], want[k])


def test_arima_known_answers(spark):
    squares = {"q": [float(t * t) for t in range(60)], "z": [0.0] * 40, "n": [None] * 40, "c": [7.0] * 30}
    got = by_series(ar.arima(panel(spark, squares), (0, 2, 0), 3, "D"))
    assert np.allclose(got["q"], [3600, 3721, 3844]) and got["z"] == [0, 0, 0] and got["n"] == [0, 0, 0] and np.allclose(got["c"], 7)
    with pytest.raises(ValueError):
        ar.arima(panel(spark, squares), (9, 0, 0), 3, "D")


def test_order_search_equals_brute_force(spark):
    data = walks(50, (60, 70, 80), 7)
    rows = {r["unique_id"]: r["order"] for r in ar.auto_arima(panel(spark, data), 1, "D").collect()}
    for k, v in data.items():
        assert rows[k] == "(%d,%d,%d)" % dense_auto(v, 1)[1], k


def test_order_search_forecasts(spark):
    data = walks(4) | {"tiny": [3.0, 5.0]}
    got = by_series(ar.auto_arima(panel(spark, data), 3, "D"))
    for k, v in data.items():
        assert np.allclose(got[k], dense_auto(np.asarray(v, float), 3)[0], rtol=1e-6, atol=1e-6)


# --- STL ---------------------------------------------------------------------

@pytest.mark.parametrize("m", [3, 4, 7])
def test_stl_equals_dense_loess(spark, m):
    rng = np.random.default_rng(m)
    data = {f"s{n}": 1000 + 0.3 * np.arange(n) + 5 * np.sin(2 * np.pi * np.arange(n) / m) + rng.normal(size=n) for n in (2 * m, 2 * m + 1, 5 * m, 9 * m + 2, 300)}
    data["short"] = np.arange(2 * m - 1.0)
    df = panel(spark, data)
    for frame in (stl_features(df, m, 3, "D"), stl_features(df, m, 3, "D", block_size=40)):
        history = frame.where("part = 'history'")
        trend, seasonal = by_series(history, "trend"), by_series(history, "seasonal")
        assert "short" not in trend
        for k in trend:
            t, s = dense_stl(np.asarray(data[k], float), m)
            assert np.allclose(trend[k], t, atol=1e-9, rtol=0) and np.allclose(seasonal[k], s, atol=1e-9, rtol=0), k
        future = by_series(frame.where("part = 'future'"), "seasonal")
        n = len(seasonal["s300"])
        assert np.allclose(future["s300"], [seasonal["s300"][n - m + i % m] for i in range(3)])


# --- smoothing ---------------------------------------------------------------

def hw_fold(y, m, p, upto=None):
    """One-step forecasts and the last state of additive Holt-Winters."""
    a, t, g = p
    l, b = y[:m].mean(), (y[m:2 * m].mean() - y[:m].mean()) / m
    s, out = list(y[:m] - l), []
    for v in y[:upto]:
        out.append(l + b + s[0])
        level = a * (v - s[0]) + (1 - a) * (l + b)
        b = t * (level - l) + (1 - t) * b
        s = [*s[1:], g * (v - level) + (1 - g) * s[0]]
        l = level
    return np.array(out), (l, b, s)


def hw_best(y, m):
    grid = [(a, t, g) for a in smoothing.HW_GRID for t in smoothing.HW_GRID for g in smoothing.HW_GRID]
    return min(grid, key=lambda p: ((y - hw_fold(y, m, p)[0]) ** 2).sum())


def test_holt_winters_fitted_values_and_long_trajectories(spark, monkeypatch):
    monkeypatch.setattr(smoothing, "CHUNK", 7)  # several runs
    data = walks(3, (40, 50, 61))
    got = by_series(smoothing.holt_winters_fitted(panel(spark, data | {"short": [1.0, 5.0, 2.0]}), 4), "HoltWinters")
    for k, v in data.items():
        assert np.allclose(got[k], hw_fold(v, 4, hw_best(v, 4))[0])
    assert got["short"] == [None, 1.0, 5.0]


def test_holt_winters_intervals(spark):
    data = walks(1, (60,))
    y = data["s00"]
    p = hw_best(y, 4)
    rows = smoothing.holt_winters(panel(spark, data), 6, "D", 4, level=[80]).orderBy("ds").collect()
    s2 = ((y - hw_fold(y, 4, p)[0]) ** 2).mean()
    c = [p[0] * (1 + j * p[1]) + (p[2] * (1 - p[0]) if j % 4 == 0 else 0) for j in range(1, 6)]
    want = [np.sqrt(s2 * (1 + sum(x * x for x in c[:k]))) * 1.2815515655446004 for k in range(6)]
    assert np.allclose([r["hi-80"] - r["yhat"] for r in rows], want) and np.allclose([r["yhat"] - r["lo-80"] for r in rows], want)


def test_holt_winters_cross_validation_keeps_its_parameters(spark):
    data = walks(2, (60, 45))
    cv = smoothing.smoothing_cv(panel(spark, data | {"short": [1.0] * 7}), 3, 3, "HoltWinters", 2, 4).collect()
    assert {r["unique_id"] for r in cv} == set(data)
    for k, y in data.items():
        n = len(y)
        p = hw_best(y[:n - 7], 4)
        for i in range(3):
            c = n - 7 + 2 * i
            _, (l, b, s) = hw_fold(y, 4, p, c)
            rows = sorted((r for r in cv if r["unique_id"] == k and r["cutoff"] == START + dt.timedelta(days=c - 1)), key=lambda r: r["ds"])
            assert np.allclose([r["HoltWinters"] for r in rows], [l + (j + 1) * b + s[j] for j in range(3)])
            assert np.allclose([r["y"] for r in rows], y[c:c + 3])


def test_adida_fitted_and_cross_validation(spark):
    y = [0, 0, 6, 0, 0, 3] * 6 + [0, 9]
    df = panel(spark, {"s": y, "z": [0] * 20})
    got = by_series(smoothing.adida_fitted(df), "ADIDA")
    # buckets of three rows counted back from the end: the first two rows and the first bucket have no forecast
    assert got["s"][:5] == [None] * 5 and got["z"] == [0.0] * 20 and got["s"][5] == got["s"][6] == got["s"][7] == sum(y[2:5]) / 3
    cv = smoothing.smoothing_cv(df, 2, 4, "ADIDA", 2).where("unique_id = 's'").orderBy("cutoff", "ds").collect()
    assert len({r["ADIDA"] for r in cv[:2]}) == 1 and len(cv) == 8
    fit = by_series(smoothing.adida(panel(spark, {"s": y[:len(y) - 8]}), 1, "D"))["s"][0]
    assert cv[0]["ADIDA"] == pytest.approx(fit)


def test_short_series_are_listed(spark):
    df = panel(spark, {"a": [1] * 9, "b": [1] * 10})
    assert [tuple(r) for r in short_series(df, 3, 3).collect()] == [("a", 9, 10)]


# --- recursion of a fitted model ---------------------------------------------

LAGS, EXPANDING, ROLLING = [1, 2, 3, 7, 14, 30, 40], [7], {14: 7, 30: 5}


def fitted(df):
    transforms = {7: [ExpandingMean()], 14: [RollingMean(7)], 30: [RollingMean(5)]}
    feats = lag_features(df, lags=LAGS, lag_transforms=transforms)
    return ml.fit(feats, [c for c in feats.columns if c not in df.columns], "linear")


def test_linear_fold_equals_rounds_with_all_seven_lags(spark):
    df = panel(spark, walks(4, (120, 150)) | {"short": np.arange(20.0), "edge": np.arange(40.0) % 7})
    model = fitted(df)
    folded = by_series(ml.recursive_forecast(model, df, 4, "D", LAGS, EXPANDING, ROLLING))
    rounds = by_series(ml.recursive_forecast(lambda f: ml.score(model, f), df, 4, "D", LAGS, EXPANDING, ROLLING))
    assert folded.keys() == rounds.keys() and folded["short"] == [None] * 4
    for k in folded:
        assert all((a is None) == (b is None) for a, b in zip(folded[k], rounds[k]))
        assert np.allclose([x for x in folded[k] if x is not None], [x for x in rounds[k] if x is not None])


def test_linear_fold_with_exogenous_dates_and_differences(spark):
    df = panel(spark, walks(2, (60,)))
    extra = df.select("unique_id", (F.col("ds") + F.expr("INTERVAL 60 DAYS")).alias("ds"), F.dayofmonth("ds").cast("double").alias("promo"))
    train = lag_features(df.withColumn("promo", F.dayofmonth("ds").cast("double")), lags=[1, 2], differences=[1], date_features=["month"])
    model = ml.fit(train, ["lag1", "lag2", "promo", "month"], "linear")
    args = dict(X_df=extra, date_features=["month"], differences=[1])
    a = by_series(ml.recursive_forecast(model, df, 5, "D", [1, 2], **args))
    b = by_series(ml.recursive_forecast(lambda f: ml.score(model, f), df, 5, "D", [1, 2], **args))
    assert all(np.allclose(a[k], b[k]) for k in b)


def test_boosted_trees_recursion_ends(spark):
    df = panel(spark, walks(3, (60,)))
    feats = lag_features(df, lags=[1, 2])
    model = ml.fit(feats, ["lag1", "lag2"], "gbt", max_iter=3)
    got = by_series(ml.recursive_forecast(model, df, 3, "D", [1, 2]))
    assert all(len(v) == 3 and None not in v for v in got.values())


def test_linear_cross_validation_sees_new_actuals(spark):
    data = walks(3, (50, 60))
    df = panel(spark, data)
    cv = ml.linear_cross_validation(df, 3, 3, "D", [1], [2], {1: 4}, step=2).collect()
    c0 = {k: len(v) - 3 - 4 for k, v in data.items()}
    feats = lag_features(df, lags=[1], lag_transforms={2: [ExpandingMean()], 1: [RollingMean(4)]})
    names = [c for c in feats.columns if c not in df.columns]
    keep = feats.join(spark.createDataFrame(list(c0.items()), "unique_id string, c int"), "unique_id") \
        .where(F.datediff("ds", F.lit(START.date())) < F.col("c"))
    model = ml.fit(keep, names, "linear")
    for i in range(3):
        cut = {k: c + 2 * i for k, c in c0.items()}
        history = panel(spark, {k: data[k][:c] for k, c in cut.items()})
        want = by_series(ml.recursive_forecast(model, history, 3, "D", [1], [2], {1: 4}))
        for k, c in cut.items():
            rows = sorted((r for r in cv if r["unique_id"] == k and r["cutoff"] == START + dt.timedelta(days=c - 1)), key=lambda r: r["ds"])
            assert np.allclose([r["linear"] for r in rows], want[k], rtol=1e-6) and np.allclose([r["y"] for r in rows], data[k][c:c + 3])


# --- MinT --------------------------------------------------------------------

def hierarchy_of(spark, groups, per_group, stamps, seed=3):
    rng = np.random.default_rng(seed)
    names = [f"g{g}/b{i}" for g in range(groups) for i in range(per_group)]
    S = [("total", n) for n in names] + [(n.split("/")[0], n) for n in names] + [(n, n) for n in names]
    nodes = sorted({a for a, _ in S})
    resid = rng.normal(size=(stamps, len(nodes))) + rng.normal(size=(stamps, 1))
    resid[rng.random(resid.shape) < 0.05] = np.nan
    base = rng.normal(size=(2, len(nodes))) * 10
    at = lambda t: START + dt.timedelta(days=t)
    frames = (spark.createDataFrame([(n, at(100 + h), float(base[h, j])) for h in range(2) for j, n in enumerate(nodes)], "unique_id string, ds timestamp_ntz, yhat double"),
              spark.createDataFrame([(n, at(t), float(resid[t, j])) for t in range(stamps) for j, n in enumerate(nodes) if not np.isnan(resid[t, j])], "unique_id string, ds timestamp_ntz, resid double"),
              spark.createDataFrame([(a, b, 1.0) for a, b in S], "node string, bottom string, weight double"))
    return nodes, names, S, base, resid, frames


def dense_mint(nodes, names, S, base, resid):
    at = {n: i for i, n in enumerate(nodes)}
    M = ~np.isnan(resid)
    X = np.where(M, resid - np.nanmean(resid, axis=0), 0.0)
    sd = np.maximum(np.nanstd(resid, axis=0, ddof=1), 1e-4)
    Z = X / sd
    n = np.maximum(M.T.astype(float) @ M, 2)
    w, w2 = Z.T @ Z, (Z * Z).T @ (Z * Z)
    var, sq = n / (n - 1) ** 3 * (w2 - w ** 2 / n), (w / (n - 1)) ** 2
    off = ~np.eye(len(nodes), dtype=bool)
    a = max(1e-6, min(1.0, max(0.0, var[off].sum() / sq[off].sum())))
    W = a * np.diag(np.maximum((X * X).sum(axis=0) / (len(X) - 1), 1e-8)) + (1 - a) * X.T @ X / (len(X) - 1)
    upper = [x for x in nodes if x not in names]
    U = np.zeros((len(nodes), len(upper)))
    for j, u in enumerate(upper):
        U[at[u], j] = 1
        for x, b in S:
            if x == u:
                U[at[b], j] -= 1
    return base.T - W @ U @ np.linalg.solve(U.T @ W @ U, U.T @ base.T), a


@pytest.mark.parametrize("block", [256, 2])
def test_mint_equals_dense_algebra_on_incoherent_forecasts(spark, monkeypatch, block):
    monkeypatch.setattr(hierarchy, "BLOCK", block)   # small blocks: the preconditioner is no inverse
    monkeypatch.setattr(hierarchy, "TILE", 5)
    monkeypatch.setattr(hierarchy, "STAMPS", 12)
    nodes, names, S, base, resid, (b, r, s) = hierarchy_of(spark, 4, 3, 40)
    want, a = dense_mint(nodes, names, S, base, resid)
    assert hierarchy.shrinkage(r) == pytest.approx(a, rel=1e-9)
    out, rounds = hierarchy.mint_solve(b, r, s, ["yhat"])
    got = by_series(out)
    assert rounds == 1 if block == 256 else rounds > 1
    for j, n in enumerate(nodes):
        assert np.allclose(got[n], want[j], atol=1e-6)
    assert hierarchy.coherence_gap(b, s, "yhat").first()["max_gap"] > 1
    assert hierarchy.coherence_gap(out, s, "yhat").first()["max_gap"] < 1e-6


def test_coherent_forecasts_stay(spark):
    _, names, S, base, _, (b, r, s) = hierarchy_of(spark, 2, 2, 12)
    coherent = hierarchy.bottom_up(b, s, ["yhat"])
    out, rounds = hierarchy.mint_solve(coherent, r, s, ["yhat"])
    got, want = by_series(out), by_series(coherent)
    assert rounds == 0 and all(np.allclose(got[k], want[k]) for k in want)
    assert DEFAULT.id == "unique_id"


def test_shrinkage_of_many_nodes_copies_no_residual(spark, monkeypatch):
    """More nodes than stamps: moments come from products of stamps, exactly, whatever stamps the nodes share."""
    monkeypatch.setattr(hierarchy, "TILE", 5)
    monkeypatch.setattr(hierarchy, "GRAM_NODES", 7)
    monkeypatch.setattr(hierarchy, "GRAM_BYTES", 5000)  # several groups of stamps
    monkeypatch.setattr(hierarchy, "_moments_by_nodes", None)
    rng = np.random.default_rng(9)
    resid = rng.normal(size=(20, 40)) + rng.normal(size=(20, 1))
    resid[:3, ::3] = np.nan    # late starts
    resid[[5, 11], 1::6] = np.nan    # holes
    resid[:, 39] = 2.0    # no spread
    rows = [(f"n{j}", START + dt.timedelta(days=t), float(resid[t, j])) for t in range(20) for j in range(40) if not np.isnan(resid[t, j])]
    M = ~np.isnan(resid)
    Z = np.where(M, resid - np.nanmean(resid, axis=0), 0.0) / np.maximum(np.nanstd(resid, axis=0, ddof=1), 1e-4)
    n = np.maximum(M.T.astype(float) @ M, 2)
    w, w2, off = Z.T @ Z, (Z * Z).T @ (Z * Z), ~np.eye(40, dtype=bool)
    want = (n / (n - 1) ** 3 * (w2 - w ** 2 / n))[off].sum() / ((w / (n - 1)) ** 2)[off].sum()
    assert 0 < want < 1
    assert hierarchy.shrinkage(spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, resid double")) == pytest.approx(want, rel=1e-9)


def test_linear_fit_reads_its_rows_once(spark):
    """The rows pass one job, and the model is that of least squares over all of them."""
    rng = np.random.default_rng(4)
    X = np.column_stack([rng.normal(5, 2, 500), rng.exponential(1e3, 500), rng.integers(0, 2, 500), np.zeros(500)])
    y = X @ [1.5, -0.01, 4.0, 0.0] + 7 + rng.normal(size=500)
    rows = [(*map(float, x), float(v)) for x, v in zip(X, y)] + [(None, 1.0, 1.0, 0.0, 1e9)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    frame = spark.createDataFrame(rows, "a double, b double, c double, z double, y double")
    model = ml.fit(frame.mapInArrow(counted, frame.schema), ["a", "b", "c"], "linear")
    assert seen.value == len(rows)
    want = np.linalg.lstsq(np.column_stack([X[:, :3], np.ones(500)]), y, rcond=None)[0]
    terms, intercept = ml.linear_terms(model)
    assert np.allclose([*terms.values(), intercept], want, rtol=1e-9)
    terms, intercept = ml.linear_terms(ml.fit(frame, ["a", "b", "c", "z"], "linear"))  # MLlib iterates if a feature has no spread
    assert np.allclose([terms["a"], terms["b"], terms["c"], intercept], want, rtol=1e-5) and terms["z"] == 0
    with pytest.raises(ValueError, match="no row"):
        ml.fit(frame.where("a is null"), ["a", "b"], "linear")
    with pytest.raises(ValueError, match="finite"):
        ml.fit(frame.where("a is not null").withColumn("y", F.lit(None).cast("double")), ["a", "b"], "linear")


def test_boosted_trees_are_mllibs_at_a_byte_a_feature(spark, tmp_path, monkeypatch):
    """Without a feature subset the trees are GBTRegressor's; a row is held as a byte per feature and its residual."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from seriesspark.operators import boosting
    rng = np.random.default_rng(5)
    X = np.round(rng.normal(size=(600, 3)), 2)
    y = np.floor(4 * X[:, 0] + 3 * np.sin(3 * X[:, 1]) * X[:, 2] + rng.normal(size=600))
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(*map(float, x), float(v)) for x, v in zip(X, y)], "a double, b double, c double, y double").repartition(3)
    df = df.unionByName(df.limit(1).withColumn("a", F.lit(None).cast("double")))
    held, grow = [], boosting._grow
    monkeypatch.setattr(boosting, "_grow", lambda blocks, *a: held.append(blocks.map(lambda b: b[0].nbytes + b[1].nbytes).sum()) or grow(blocks, *a))
    model = ml.fit(df, names, "gbt", max_iter=4)
    assert held == [600 * (3 + 8)] * 4
    mllib = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip"),
                             GBTRegressor(labelCol="y", maxDepth=5, stepSize=0.05, maxIter=4, featureSubsetStrategy="0.9", seed=42)]).fit(df)
    points = lambda m: np.array(sorted((r["a"], r["b"], r["c"], r["y"], r["prediction"]) for r in m.transform(df).collect()))
    assert np.allclose(points(model), points(mllib))
    assert np.array_equal(points(ml.save_and_load(model, str(tmp_path / "model"))), points(model))
    with pytest.raises(ValueError, match="no row to fit"):
        ml.fit(df.where("a > 100"), names, "gbt", max_iter=1)
    with pytest.raises(Exception, match="labels to fit must be finite"):
        ml.fit(df.withColumn("y", F.lit(None).cast("double")), names, "gbt", max_iter=1)


def test_boosted_trees_compute_their_features_once(spark):
    """rows are counted, sampled for thresholds and binned from one pass over the features."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    frame = spark.range(12000).selectExpr("cast(id % 97 as double) a", "cast(id % 89 as double) b", "cast(id % 13 as double) y").repartition(3)
    model = ml.fit(frame.mapInArrow(counted, frame.schema), ["a", "b"], "gbt", max_iter=2)
    assert seen.value == 12000
    vectors = ml.build_regressor(["a", "b"], "gbt", max_iter=2)
    vectors.getStages()[-1].given.pop("inputCols")  # from the vector alone
    assert model.stages[-1].getOrDefault("trees") == vectors.fit(frame).stages[-1].getOrDefault("trees")


def test_boosting_passes_are_those_of_plain_loops(spark):
    """places sampled are the JVM's, nodes and histograms those of a row at a time, sums the same in any number of tasks."""
    from pyspark.sql import DataFrame

    from seriesspark.operators import boosting
    counts = [3000, 0, 5, 9000]
    rows = spark.sparkContext.parallelize(range(4), 4).flatMap(lambda i: [(i, j) for j in range(counts[i])]).toDF("p long, i long")
    for fraction, seed in ((0.05, 123456789), (0.7, 3987654321)):
        jvm = DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.javaRDD().sample(False, fraction, seed - (1 << 32) * (seed >> 31)), rows._jdf.schema()), spark)
        assert [(p, i) for p, at in enumerate(boosting._sampled(counts, fraction, seed)) for i in at] == [tuple(r) for r in jvm.collect()]
    rng = np.random.default_rng(3)
    bins, r = rng.integers(0, 34, (3, 500)).astype(np.uint8), rng.integers(-9, 9, 500).astype(float)
    feature, cut = rng.integers(0, 3, 8), np.array([0, 9, 20, boosting.WIDTH, 5, 16, boosting.WIDTH, 30])
    node = boosting._descend(bins, feature, cut, 3)
    for i in range(500):
        at = 1
        for _ in range(3):
            at = 2 * at + int(bins[feature[at], i] > cut[at])
        assert node[i] == at - 8
    squares, counted, sums = np.split(boosting._histogram(bins, r, node, 8), [8, 8 + 3 * 8 * boosting.WIDTH])
    want = np.zeros((2, 3, 8, boosting.WIDTH))
    for f in range(3):
        np.add.at(want[0, f], (node, bins[f]), 1)
        np.add.at(want[1, f], (node, bins[f]), r)
    assert np.array_equal(counted, want[0].ravel()) and np.array_equal(sums, want[1].ravel()) and np.array_equal(squares, np.bincount(node, r * r, minlength=8))
    x = rng.normal(size=(6, 100))
    blocks = [(v, i // 3) for i, v in enumerate(x)]
    of = lambda v: np.concatenate([v[:1], v[:boosting.WIDTH], v[:boosting.WIDTH]])
    one, two = (boosting._summed(spark.sparkContext.parallelize(blocks, n), of, 1, 1) for n in (1, 2))
    assert all(np.array_equal(a, b) for a, b in zip(one, two))
