import datetime as dt
import json

import numpy as np
from dense import arima, auto_arima, stl
from pyspark.sql import functions as F

from seriesspark.functions.contracts import Cols
from seriesspark.operators.ml import parse_payload, scoring_payload
from seriesspark.operators.smoothing import adida, holt_winters
from seriesspark.operators.solvers import forecast_grouped
from seriesspark.operators.sqlfn import register_forecast_table

D = dt.datetime


def series(spark, values, name="s"):
    rows = [(name, D(2024, 1, 1) + dt.timedelta(days=t), None if v is None else float(v)) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")


def test_holt_winters_recovers_exact_pattern(spark):
    season = [3.0, -1.0, -2.0, 0.0]
    y = [10 + 0.5 * t + season[t % 4] for t in range(40)]
    rows = holt_winters(series(spark, y), 4, "D", 4).orderBy("ds").collect()
    want = [10 + 0.5 * t + season[t % 4] for t in range(40, 44)]
    assert np.allclose([r.yhat for r in rows], want, atol=0.5)
    assert rows[0].ds == D(2024, 1, 1) + dt.timedelta(days=40)
    short = holt_winters(series(spark, [1.0, 2.0, 7.0]), 2, "D", 4).collect()
    assert [r.yhat for r in short] == [7.0, 7.0]


def test_adida_levels(spark):
    # a demand of 6 every third day: buckets of three rows, all 6, level 6, two a day
    got = {r.unique_id: r.yhat for r in adida(series(spark, [0, 0, 6] * 10).unionByName(series(spark, [0] * 9, "z")), 1, "D").collect()}
    assert got == {"s": 2.0, "z": 0.0}


def test_arima_integrates_twice():
    y = np.array([float(t * t) for t in range(60)])
    assert np.allclose(arima(y, (0, 2, 0), 3), [3600, 3721, 3844], atol=1e-6)


def test_auto_arima_prefers_low_order_on_white_noise():
    rng = np.random.default_rng(11)
    y = rng.normal(size=300)
    fc, (p, d, q) = auto_arima(y, 3)
    assert d == 0 and p + q <= 2
    assert np.all(np.abs(fc) < 1.0)


def test_stl_splits_trend_and_season():
    season = np.array([2.0, -1.0, -1.0])
    y = np.array([0.1 * t + season[t % 3] for t in range(60)])
    trend, seas = stl(y, 3)
    assert np.allclose(seas, [season[t % 3] for t in range(60)], atol=0.3)
    assert np.allclose(trend, [0.1 * t for t in range(60)], atol=0.3)


def test_stl_ends_at_a_high_level():
    season = np.array([5.0, -3.0, -2.0])
    trend, seas = stl(1000 + season[np.arange(36) % 3], 3)
    assert np.allclose(seas, season[np.arange(36) % 3], atol=0.1) and np.allclose(trend, 1000, atol=0.1)


def test_grouped_forecast_shapes(spark):
    rows = [(i, D(2024, 1, 1) + dt.timedelta(days=t), float((t % 7) + (i == "b"))) for i in ("a", "b") for t in range(60)]
    df = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")
    out = forecast_grouped(df, 5, "D", ("ARIMA",))
    assert out.count() == 2 * 5
    own = forecast_grouped(df, 5, "D", {"Last": lambda y, h: np.repeat(y[-1], h), "Mean": lambda y, h: np.repeat(y.mean(), h)})
    assert {r.yhat for r in own.where("model = 'Last' AND unique_id = 'a'").collect()} == {3.0}
    assert out.select(F.min("ds")).first()[0] == D(2024, 3, 1)


def test_sql_table_function_horizon_exclusive(spark):
    register_forecast_table(spark)
    rows = [("g1", D(2024, 1, 1) + dt.timedelta(days=t), float(t)) for t in range(10)]
    spark.createDataFrame(rows, "grp string, ds timestamp_ntz, y double").createOrReplaceTempView("ts_in")
    out = spark.sql("""SELECT * FROM ts_forecast(TABLE(ts_in) PARTITION BY grp ORDER BY ds,
                       horizon => '2024-01-15', frequency => 'D', prediction_interval_width => 0.8)""").collect()
    named = spark.sql("""SELECT * FROM ts_forecast(TABLE(SELECT grp AS shop, ds AS day, y AS sold FROM ts_in) PARTITION BY shop ORDER BY day,
                         horizon => '2024-01-15', time_col => 'day', value_col => 'sold', group_col => 'shop')""").collect()
    assert named == out
    assert [r.ds.day for r in out] == [11, 12, 13, 14]
    assert all(r.forecast == 9.0 for r in out)
    # one-step differences are all 1 -> sigma 1; interval grows with sqrt(k)
    assert abs((out[0].upper - out[0].forecast) - 1.2815515655446004) < 1e-9


def test_scoring_payload_round_trip(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 4.0)], "unique_id string, lag1 double, lag2 double")
    p = scoring_payload(df, ["lag1", "lag2"], "unique_id").collect()[0]
    doc = json.loads(p.payload)
    assert doc["dataframe_split"]["columns"] == ["lag1", "lag2"]
    assert sorted(doc["dataframe_split"]["data"]) == [[1.0, 2.0], [3.0, 4.0]]
    back = parse_payload(scoring_payload(df, ["lag1", "lag2"], "unique_id"))
    assert back.count() == 2


def test_cv_cutoffs_formula(spark):
    from seriesspark.operators.split import cv_cutoffs
    rows = [("a", D(2024, 1, 1) + dt.timedelta(days=t), 1.0) for t in range(20)]
    df = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")
    got = sorted((r.window, r.cutoff_rn) for r in cv_cutoffs(df, 3, 4, 2, Cols()).collect())
    assert got == [(0, 11), (1, 13), (2, 15), (3, 17)]


def test_knn_matches_brute_force_on_separated_clusters(spark):
    from seriesspark.operators.ml import knn_regress
    rng = np.random.default_rng(4)
    centres = np.array([[0.0, 0.0], [50.0, 50.0], [-50.0, 80.0]])
    train, query = [], []
    for c, (cx, cy) in enumerate(centres):
        for i in range(30):
            x = [float(cx + rng.normal(scale=0.5)), float(cy + rng.normal(scale=0.5))]
            train.append((f"t{c}_{i:02d}", x[0], x[1], float(c * 10 + rng.integers(0, 5))))
        query.append((f"q{c}", float(cx + 0.1), float(cy - 0.1), 0.0))
    tr = spark.createDataFrame(train, "id string, a double, b double, y double")
    qu = spark.createDataFrame(query, "id string, a double, b double, y double")
    got = {r.id: r.knn for r in knn_regress(tr, qu, ["a", "b"], 5, "y", ["id"]).collect()}
    X = np.array([[t[1], t[2]] for t in train])
    ys = np.array([t[3] for t in train])
    mu, sd = X.mean(axis=0), X.std(axis=0)
    for qid, qa, qb, _ in query:
        d = np.sqrt((((X - mu) / sd - (np.array([qa, qb]) - mu) / sd) ** 2).sum(axis=1))
        want = ys[np.argsort(d, kind="stable")[:5]].mean()
        assert got[qid] is not None and abs(got[qid] - want) < 1e-9


def test_grid_position_holdout_equals_window_holdout(spark):
    from seriesspark.operators.split import label_holdout
    rows = [(i, D(2024, 1, 1) + dt.timedelta(days=t), float(t)) for i, n in (("a", 10), ("b", 2), ("c", 30))
            for t in range(n)]
    df = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")
    plain = label_holdout(df, 3)
    grid = label_holdout(df, 3, freq="D")
    assert plain.exceptAll(grid.select(*plain.columns)).count() == 0
    assert grid.filter("unique_id = 'b' AND split = 'test'").count() == 2


def test_knn_constant_feature_hot_value_and_ties(spark):
    from seriesspark.operators.ml import knn_regress
    train = [(f"t{i:03d}", float(i), 1.0, float(i)) for i in range(20)] + [(f"h{i:03d}", 50.0, 1.0, 7.0) for i in range(300)]
    tr = spark.createDataFrame(train, "id string, a double, b double, y double").repartition(4)
    qu = spark.createDataFrame([("q0", 0.0, 1.0), ("q1", 19.0, 5.0), ("q2", 50.0, None), ("q3", 49.0, 1.0)], "id string, a double, b double")
    got = {r.id: r.knn for r in knn_regress(tr, qu, ["a", "b"], 3, "y", ["id"]).collect()}
    assert got == {"q0": 1.0, "q1": 18.0, "q2": None, "q3": 7.0}
    empty = knn_regress(tr.limit(0), qu, ["a", "b"], 3, "y", ["id"]).collect()
    assert len(empty) == 4 and all(r.knn is None for r in empty)


def test_recursive_forecast_short_series_and_inverse_difference(spark):
    from seriesspark.operators.ml import recursive_forecast
    df = series(spark, range(5), "short").unionByName(series(spark, range(30), "long"))
    rule = lambda f: f.withColumn("prediction", F.col("lag8") + F.lit(8.0))
    got = {}
    for r in recursive_forecast(rule, df, 3, "D", [8]).orderBy("ds").collect():
        got.setdefault(r.unique_id, []).append(r.yhat)
    assert got == {"short": [None, None, None], "long": [30.0, 31.0, 32.0]}
    flat = lambda f: f.withColumn("prediction", F.col("lag1"))
    out = recursive_forecast(flat, df, 3, "D", [1], differences=[1]).orderBy("unique_id", "ds").collect()
    assert [r.yhat for r in out] == [30.0, 31.0, 32.0, 5.0, 6.0, 7.0]
    exog = spark.createDataFrame([("long", D(2024, 1, 31), 5.0)], "unique_id string, ds timestamp_ntz, promo double")
    plus = lambda f: f.withColumn("prediction", F.col("lag1") + F.coalesce("promo", F.lit(0.0)) + F.col("month"))
    out = recursive_forecast(plus, df.where("unique_id = 'long'"), 2, "D", [1], X_df=exog, date_features=["month"]).orderBy("ds").collect()
    assert [r.yhat for r in out] == [29 + 5 + 1, 35 + 2]


def test_linear_scoring_keeps_rows_with_a_missing_feature(spark):
    from seriesspark.operators.ml import fit, score
    train = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    model = fit(train, ["x"], "linear")
    out = score(model, spark.createDataFrame([(1, 3.0), (2, None)], "id int, x double")).orderBy("id").collect()
    assert abs(out[0].prediction - 7.0) < 1e-6 and out[1].prediction is None and out[1].x is None


def test_covariate_forecast_keeps_series_with_a_null_covariate(spark):
    from seriesspark.operators.ml import quantile_forecast_covariates
    rows = [(s, D(2024, 1, 1) + dt.timedelta(days=t), float(t + (t * 7) % 5), None if s == "b" and t == 29 else float((t * 3) % 4))
            for s in ("a", "b") for t in range(30)]
    df = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double, c double")
    out = quantile_forecast_covariates(df, ["c"], 2, "D").collect()
    assert len(out) == 4 and all((r.predictions is None) == (r.unique_id == "b") for r in out)


def test_payload_without_groups_is_split(spark):
    df = spark.range(2500).select(F.col("id").cast("double").alias("x"))
    p = scoring_payload(df, ["x"])
    assert p.count() == 3 and parse_payload(p).count() == 2500


def test_holt_winters_fits_many_series_in_batches(spark):
    """The grid of many series within a minute, each the same as a plain loop finds."""
    import time

    from seriesspark.operators.smoothing import HW_GRID, holt_winters_fitted
    n = F.when(F.col("id") % 3 == 0, 61).when(F.col("id") % 3 == 1, 7).otherwise(60)
    y = F.when(F.col("k") % 11 == 5, None).otherwise((F.xxhash64("id", "k") % 1000) / 8)
    rows = spark.range(3000).withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))) \
        .select(F.col("id").alias("unique_id"), F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(cast(k as int))").alias("ds"), y.alias("y"))
    began, got = time.time(), {}
    for r in holt_winters_fitted(rows, 4).orderBy("unique_id", "ds").collect():
        got.setdefault(r["unique_id"], []).append((r["y"], r["HoltWinters"]))
    assert time.time() - began < 60
    assert len(got) == 3000 and got[1][0][1] is None and [f for _, f in got[1][1:]] == [v for v, _ in got[1][:-1]]

    def loop(values, a, t, g):
        level = sum(values[:4], 0.0) / 4
        trend, season = (sum(values[4:8], 0.0) / 4 - level) / 4, [v - level for v in values[:4]]
        sse, path = 0.0, []
        for v in values:
            path.append(level + trend + season[0])
            new = a * (v - season[0]) + (1 - a) * (level + trend)
            trend, season, level = t * (new - level) + (1 - t) * trend, [*season[1:], g * (v - new) + (1 - g) * season[0]], new
            sse += (v - path[-1]) * (v - path[-1])
        return sse, path
    for i in (0, 2, 3, 2999, 2997):
        values = [v for v, _ in got[i]]
        fits = [loop(values, a, t, g) for a in HW_GRID for t in HW_GRID for g in HW_GRID]
        assert [f for _, f in got[i]] == min(fits, key=lambda x: x[0])[1]


def _reads(df):
    """Relations of the plan that read the input, not a checkpoint."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_model_choice_and_quantiles_write_the_history_once(spark, tmp_path):
    """no model, fit or quantile computes the history again."""
    from seriesspark.operators.evaluation import choose_and_forecast
    from seriesspark.operators.ml import quantile_forecast_covariates
    from seriesspark.plans.catalog import registry
    spark.createDataFrame([("a", D(2020, 1, 1) + dt.timedelta(days=i), float(i % 5), float(i % 3)) for i in range(40)],
                          "unique_id string, ds timestamp_ntz, y double, c double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert _reads(df) == 1
    chosen = choose_and_forecast(df.drop("c"), registry(3, "D", 5, Cols()), "mae")
    assert _reads(chosen) == 0 and chosen.count() == 3
    quantiles = quantile_forecast_covariates(df, ["c"], 2, "D")
    assert _reads(quantiles) == 0 and quantiles.count() == 2


def test_filled_daily_panel_is_partitioned_by_rows(spark, monkeypatch):
    """partitions follow the tables' rows, also those of the blocks, where AQE would merge them."""
    from seriesspark.plans import catalog
    from seriesspark.sources import bindings
    monkeypatch.setattr(bindings, "SERIES", 1)
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/supplier.parquet").count()
    assert bindings.daily_partitions(catalog.Tables(spark, sf)) == n
    for df in (catalog.daily_filled(catalog.Tables(spark, sf)), catalog.QUERIES["differenced_features_blocked"](spark, sf)):
        assert df.rdd.getNumPartitions() == n


def test_order_search_is_partitioned_by_rows(spark, monkeypatch):
    """the wide rows of the order search lie in partitions of PART_ROWS rows, and the history is read once."""
    from seriesspark.operators import arima as module
    monkeypatch.setattr(module, "PART_ROWS", 10)
    rows = [(f"s{i}", D(2020, 1, 1) + dt.timedelta(days=k), float((k * 7 + i) % 5)) for i in range(6) for k in range(40)]
    df = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double").repartition(2)
    out = module.auto_arima(df, 2, "D")
    assert out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(unique_id") and out.count() == 12
    assert ", 24), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_knn_bounds_queries_by_their_nearest_cell(spark):
    """many rows near few queries in seconds, ties by key, the same as brute force; repeated query keys are kept."""
    from seriesspark.operators.ml import knn_regress
    rng = np.random.default_rng(5)
    X = np.round(np.concatenate([rng.normal(0, 1, (3000, 2)), rng.normal(0, 50, (40, 2))]), 1)
    train = spark.createDataFrame([(i, float(a), float(b), float(i % 7)) for i, (a, b) in enumerate(X.tolist())], "k bigint, a double, b double, y double")
    Q = np.concatenate([np.round(rng.normal(0, 1, (200, 2)), 1), [[400.0, -3.0]]])
    query = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(Q.tolist())], "k bigint, a double, b double")
    got = {r["k"]: r["knn"] for r in knn_regress(train, query, ["a", "b"], 3, "y", ["k"]).collect()}
    s = X.std(axis=0)
    for i, q in enumerate(Q):
        d = np.round(np.sqrt((((X - X.mean(axis=0)) / s - (q - X.mean(axis=0)) / s) ** 2).sum(axis=1)), 9)
        kept = np.lexsort((np.arange(len(X)), d))[:3]
        assert abs(got[i] - (kept % 7).mean()) < 1e-9, i


def test_knn_cells_groups_and_ties_are_those_of_all_pairs(spark, monkeypatch):
    """many cells, groups of queries, a value that a third of the rows share, ties by key with NULL first: the same as all pairs."""
    from seriesspark.operators import ml
    monkeypatch.setattr(ml, "CELL_ROWS", 100)
    monkeypatch.setattr(ml, "CELL_SAMPLE", 12)
    rng = np.random.default_rng(7)
    X = np.concatenate([np.round(rng.normal(0, 1, (2000, 3)), 1), np.zeros((1000, 3)), rng.normal(0, 30, (20, 3))])
    X[:, 2] *= rng.random(len(X)) < 0.2
    order = rng.permutation(len(X))
    keys = [None if i == order[5] else int(i) for i in order]
    train = spark.createDataFrame([(i, *map(float, x), float(j % 11)) for j, (i, x) in enumerate(zip(keys, X))], "k bigint, a double, b double, c double, y double").repartition(5)
    Q = np.concatenate([np.round(rng.normal(0, 1, (300, 3)), 1), np.zeros((250, 3)), [[900.0, -900.0, 5.0]]])
    query = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(Q)], "k bigint, a double, b double, c double")
    got = {r["k"]: r["knn"] for r in ml.knn_regress(train, query, ["a", "b", "c"], 4, "y", ["k"]).collect()}
    assert len(got) == len(Q)
    m, s = X.mean(axis=0), X.std(axis=0)
    rank = np.array([-1 if i is None else i for i in keys])
    for i, q in enumerate(Q):
        d = np.round(np.sqrt((((X - m) / s - (q - m) / s) ** 2).sum(axis=1)), 9)
        kept = np.lexsort((rank, d))[:4]
        assert abs(got[i] - (kept % 11).mean()) < 1e-9, i
    few = ml.knn_regress(train.limit(3), query.limit(2), ["a", "b", "c"], 4, "y", ["k"]).collect()
    assert len(few) == 2 and len({r["knn"] for r in few}) == 1 and few[0]["knn"] is not None
    assert ml.knn_regress(train, query.limit(0), ["a", "b", "c"], 4, "y", ["k"]).collect() == []


def test_knn_bound_and_leaves_hold_the_nearest_rows():
    """the sample's bound is no less than the k-th distance and near it; leaves return the rows within it."""
    from seriesspark.operators import ml
    rng = np.random.default_rng(8)
    X, Q = rng.normal(size=(4000, 2)), rng.normal(size=(50, 2))
    cells = ml._Cells(X[::4], 20, 3)
    bound, brute = cells.bound(Q), np.sort(np.sqrt(((Q[:, None] - X) ** 2).sum(axis=2)), axis=1)
    assert (bound >= brute[:, 2]).all() and np.median(bound / brute[:, 2]) < 4
    cell, (q, c) = cells.of(X), cells.within(Q, bound)
    nearest = ((Q[:, None] - X) ** 2).sum(axis=2).argmin(axis=1)
    assert {(i, cell[n]) for i, n in enumerate(nearest)} <= set(zip(q, c)) and len(c) < 50 * 10
    found = [np.concatenate(x) for x in zip(*ml._Leaves(X).near(Q, bound, 3))]
    assert len(found[0]) == 150 and np.allclose(found[2].reshape(50, 3), brute[:, :3], atol=1e-8)


def test_knn_forecast_computes_its_features_once(spark, tmp_path):
    """training rows and holdout are read from rows written once, not computed again from the items."""
    from seriesspark.plans.catalog import QUERIES
    day = D(2020, 1, 1)
    items = [(o, 1 + o % 3, float(1 + (o * 7 + d) % 9), day + dt.timedelta(days=d)) for d in range(0, 420, 2) for o in (d % 3, d % 3 + 1)]
    spark.createDataFrame(items, "l_orderkey int, l_suppkey bigint, l_quantity double, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "s_suppkey bigint, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(1, "N", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(1, "R")], "r_regionkey int, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    out = QUERIES["knn_forecast"](spark, str(tmp_path))
    assert not [f for f in out.inputFiles() if "lineitem" in f]
    rows = out.collect()
    assert len(rows) == 21 and all(r["knn"] is not None for r in rows)


def test_table_function_neither_shuffles_nor_redeals_the_grid(spark, tmp_path):
    """The sparse panel is dealt as PARTITION BY deals the table argument: no grid row is shuffled."""
    from seriesspark.plans.catalog import QUERIES
    rows = [(k % 3, D(2001, 11, 1) + dt.timedelta(days=3 * (k // 3)), float(k)) for k in range(9)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_shipdate timestamp_ntz, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["forecast_table_fn"](spark, str(tmp_path))
    found = {(r.grp, r.ds.day): r.forecast for r in got.collect()}
    assert found == {(str(k), day): 6.0 + k for k in range(3) for day in range(8, 12)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and "REPARTITION_BY_NUM" in plan
    assert "REPARTITION_BY_COL" not in plan
