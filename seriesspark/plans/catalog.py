"""Named queries over the driver's tables.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame. These are
thin bindings: all logic lives in ``seriesspark.operators``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesspark.operators import relational as rel
from seriesspark.functions.contracts import Cols
from seriesspark.operators.grid import fill_grid
from seriesspark.session import cut_lineage, write_once
from seriesspark.sources import bindings as b
from seriesspark.sources.tables import Tables

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _enriched(t: Tables, with_dims: bool = False) -> DataFrame:
    dims = dict(products=b.products(t), sellers=b.sellers(t), customers=b.customers(t)) if with_dims else {}
    return rel.enrich_items(b.items(t), b.orders(t), b.payments(t), b.reviews(t), **dims)


@query
def enriched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivered item fact with all lookups."""
    t = Tables(spark, sf_dir)
    return _enriched(t, with_dims=True)


@query
def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: one monthly series with eight measures."""
    t = Tables(spark, sf_dir)
    return rel.monthly_series(_enriched(t))


def seller_panel(t: Tables, min_active_months: int = 8) -> DataFrame:
    enriched = _enriched(t)
    raw = rel.seller_monthly_raw(enriched)
    active = rel.keep_active(raw, "seller_id", min_active_months)
    return fill_grid(active, Cols("seller_id", "month"), "MS", start="global", end="global",
                     zero_cols=rel.SELLER_SUM_COLS, carry_cols=rel.SELLER_AVG_COLS,
                     bounds_from=enriched)


@query
def seller_monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-filled monthly panel of active sellers."""
    return seller_panel(Tables(spark, sf_dir), 8)


@query
def seller_monthly_panel_70(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same panel with a threshold that actually removes sellers (D5 test)."""
    return seller_panel(Tables(spark, sf_dir), 70)


# ------------------------------------------------------------ helpers

def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (oracle hygiene: sums differ in the last bits)."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


SELLER = Cols("seller_id", "month", "revenue")
H_SELLER, M_SELLER = 3, 12


def _seller_split(t: Tables):
    from seriesspark.operators.split import train_test
    panel = seller_panel(t, 8).select("seller_id", "month", "revenue")
    return train_test(panel, H_SELLER, SELLER)


def _seller_preds(train: DataFrame) -> dict[str, DataFrame]:
    from seriesspark.operators.forecast import closed_form_forecast
    out = {}
    for model in ("Naive", "SeasonalNaive"):
        fc = closed_form_forecast(train, H_SELLER, "MS", (model,), M_SELLER, cols=SELLER)
        out[model] = fc.withColumnRenamed(model, "predictions")
    return out


# ------------------------------------------------------------ split / forecast / metrics

@query
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last 3 months of every seller labelled test."""
    from seriesspark.operators.split import label_holdout
    panel = seller_panel(Tables(spark, sf_dir), 8).select("seller_id", "month", "revenue")
    return label_holdout(panel, H_SELLER, SELLER)


@query
def holdout_split_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 with grid positions (no whole-series window); same rows as ``holdout_split``."""
    from seriesspark.operators.split import label_holdout
    panel = seller_panel(Tables(spark, sf_dir), 8).select("seller_id", "month", "revenue")
    return label_holdout(panel, H_SELLER, SELLER, freq="MS")


@query
def first_n_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two rows of every seller."""
    from seriesspark.operators.split import head_per_series
    panel = seller_panel(Tables(spark, sf_dir), 8).select("seller_id", "month", "revenue")
    return head_per_series(panel, 2, SELLER)


@query
def seller_forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive forecast of the holdout scored with MAE/RMSE/MAPE."""
    from seriesspark.operators.evaluation import calc_metrics
    train, test = _seller_split(Tables(spark, sf_dir))
    pred = _seller_preds(train)["Naive"]
    return round_doubles(calc_metrics(test, pred, "revenue", "seller_id", "month"))


@query
def approach_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metrics row per approach."""
    from seriesspark.operators.evaluation import compare_approaches
    train, test = _seller_split(Tables(spark, sf_dir))
    return round_doubles(compare_approaches(_seller_preds(train), test, "revenue", "seller_id", "month"))


@query
def cross_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual vs predicted for the first 50 sellers, both approaches."""
    from seriesspark.operators.evaluation import cross_rows as build
    train, test = _seller_split(Tables(spark, sf_dir))
    sample = rel.first_ids(test, "seller_id", 50)
    test_sample = rel.semi_join(test, sample, "seller_id")
    return build(_seller_preds(train), test_sample, "revenue", "seller_id", "month")


@query
def top_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four largest sellers by training revenue, with a display label."""
    train, _ = _seller_split(Tables(spark, sf_dir))
    top = rel.top_groups(train, "seller_id", "revenue", 4)
    return round_doubles(top.withColumn(
        "label", F.concat(F.lit("Seller "), F.substring(F.col("seller_id").cast("string"), 1, 8), F.lit("..."))))


@query
def naive_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point forecasts with 80 percent intervals."""
    from seriesspark.operators.forecast import closed_form_forecast
    train, _ = _seller_split(Tables(spark, sf_dir))
    return round_doubles(closed_form_forecast(train, H_SELLER, "MS", ("Naive", "SeasonalNaive"),
                                              M_SELLER, level=[80], cols=SELLER))


@query
def naive_intervals_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, F7 from the time-blocked summary (24-month blocks); same rows as ``naive_intervals``."""
    from seriesspark.operators.forecast import closed_form_forecast
    train, _ = _seller_split(Tables(spark, sf_dir))
    return round_doubles(closed_form_forecast(train, H_SELLER, "MS", ("Naive", "SeasonalNaive"),
                                              M_SELLER, level=[80], cols=SELLER, block_size=24))


@query
def fitted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: in-sample fitted values of both closed-form models."""
    from seriesspark.operators.forecast import fitted_values as fv
    panel = seller_panel(Tables(spark, sf_dir), 8).select("seller_id", "month", "revenue")
    return fv(panel, M_SELLER, cols=SELLER)


@query
def fitted_values_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 on 24-month blocks with a 12-step halo; same rows as ``fitted_values``."""
    from seriesspark.operators.forecast import fitted_values as fv
    panel = seller_panel(Tables(spark, sf_dir), 8).select("seller_id", "month", "revenue")
    return fv(panel, M_SELLER, cols=SELLER, block_size=24, freq="MS")


@query
def quantile_forecast_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 with the residual window on 24-month blocks; same rows as ``quantile_forecast``."""
    from seriesspark.operators.forecast import quantile_forecast as qf
    train, _ = _seller_split(Tables(spark, sf_dir))
    return round_doubles(qf(train, H_SELLER, "MS", cols=SELLER, block_size=24))


@query
def quantile_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quantile forecast 0.1/0.5/0.9 from empirical naive residuals."""
    from seriesspark.operators.forecast import quantile_forecast as qf
    train, _ = _seller_split(Tables(spark, sf_dir))
    return round_doubles(qf(train, H_SELLER, "MS", cols=SELLER))


@query
def quantile_forecast_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 covariate form: direct linear models on past covariates, residual quantiles."""
    from seriesspark.operators.ml import quantile_forecast_covariates as qfc
    from seriesspark.operators.split import train_test
    panel = seller_panel(Tables(spark, sf_dir), 8)
    covs = ["order_count", "avg_price", "avg_freight", "avg_delivery_days", "avg_review_score"]
    train, _ = train_test(panel.select("seller_id", "month", "revenue", *covs), H_SELLER, SELLER)
    return round_doubles(qfc(train, covs, H_SELLER, "MS", cols=SELLER), 2)


# ------------------------------------------------------------ daily panel and features

def daily_filled(t: Tables, partitions: int | None = None) -> DataFrame:
    """J11 + P13: sparse daily panel on the global day grid, missing demand 0.

    The grid holds many rows for one of the sparse panel, so its partitions are sized by
    the tables' rows, not by the bytes that are shuffled before it is filled. ``partitions``
    fixes their number.
    """
    panel = b.daily_panel(t)
    return fill_grid(panel.repartition(partitions or b.daily_partitions(t), "unique_id"), Cols(), "D", start="global", end="global", zero_cols=["y"], bounds_from=panel)


@query
def fill_gaps_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel gap-filled between global bounds."""
    return daily_filled(Tables(spark, sf_dir))


@query
def fill_gaps_global_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, P13 with 100-day time blocks; same rows as ``fill_gaps_global``."""
    t = Tables(spark, sf_dir)
    return fill_grid(b.daily_panel(t), Cols(), "D", start="global", end="global", zero_cols=["y"],
                     block_size=100)


@query
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical lag feature set with static attributes."""
    from seriesspark.operators.features import ExpandingMean, RollingMean, lag_features as lf
    t = Tables(spark, sf_dir)
    panel = daily_filled(t).join(b.static_attributes(t), "unique_id", "inner")
    return lf(panel, lags=[1, 2, 3, 7, 14, 30, 360],
              lag_transforms={7: [ExpandingMean()], 14: [RollingMean(7)], 30: [RollingMean(14)]})


@query
def lag_features_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7-W9 on 400-day time blocks with a look-back halo: the skew-safe plan
    for series too long for one task; same rows as ``lag_features``."""
    from seriesspark.operators.features import ExpandingMean, RollingMean, lag_features as lf
    t = Tables(spark, sf_dir)
    panel = daily_filled(t).join(b.static_attributes(t), "unique_id", "inner")
    return lf(panel, lags=[1, 2, 3, 7, 14, 30, 360],
              lag_transforms={7: [ExpandingMean()], 14: [RollingMean(7)], 30: [RollingMean(14)]},
              block_size=400, freq="D", partitions=b.daily_partitions(t))


@query
def differenced_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differenced target, lags 3/6, transforms, calendar features."""
    from seriesspark.operators.features import ExpandingMean, RollingMean, lag_features as lf
    t = Tables(spark, sf_dir)
    return lf(daily_filled(t), lags=[3, 6],
              lag_transforms={3: [ExpandingMean(), RollingMean(3)], 6: [ExpandingMean(), RollingMean(6)]},
              date_features=["quarter", "daysinmonth"], differences=[1])


@query
def differenced_features_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10, X7 on 100-day time blocks; same rows as ``differenced_features``."""
    from seriesspark.operators.features import ExpandingMean, RollingMean, lag_features as lf
    t = Tables(spark, sf_dir)
    return lf(daily_filled(t), lags=[3, 6],
              lag_transforms={3: [ExpandingMean(), RollingMean(3)], 6: [ExpandingMean(), RollingMean(6)]},
              date_features=["quarter", "daysinmonth"], differences=[1], block_size=100, freq="D", partitions=b.daily_partitions(t))


# ------------------------------------------------------------ 10-minute panel (intro path)

TEN_MIN_EXCLUDED = ["error"]


def tenmin_clean(t: Tables) -> DataFrame:
    from seriesspark.operators.clean import mask_outliers
    return mask_outliers(b.ten_minute_panel(t), excluded=TEN_MIN_EXCLUDED)


def tenmin_regular(t: Tables) -> DataFrame:
    """P9 then J10 + W3 + W4: outliers masked, per-series 10-minute grid, ffill/bfill."""
    return fill_grid(tenmin_clean(t), Cols(), "10min", carry_cols=["y"])


@query
def outlier_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-series 5/95 percentile fence, outliers set to NULL."""
    return tenmin_clean(Tables(spark, sf_dir))


@query
def regular_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-series 10-minute grid with forward/backward fill."""
    return tenmin_regular(Tables(spark, sf_dir))


@query
def regular_grid_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, W3, W4 with 1-day (144-step) time blocks; same rows as ``regular_grid``."""
    return fill_grid(tenmin_clean(Tables(spark, sf_dir)), Cols(), "10min", carry_cols=["y"], block_size=144)


@query
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling mean/std over 1 and 5 days, full window required, long by window."""
    from seriesspark.operators.features import rolling_stats as rs
    wide = rs(tenmin_regular(Tables(spark, sf_dir)), (144, 720), exact_scale=4)
    long = wide.selectExpr("unique_id", "ds", "y",
                           "stack(2, 144, rolling_mean_144, rolling_std_144, "
                           "720, rolling_mean_720, rolling_std_720) AS (window, rolling_mean, rolling_std)")
    return long.withColumn("rolling_std", F.round("rolling_std", 6)).withColumn(
        "window_label", F.format_string("%d days", (F.col("window") / 144).cast("int")))


@query
def rolling_stats_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6 on 2-day blocks with a 719-step halo; same rows as ``rolling_stats``."""
    from seriesspark.operators.features import rolling_stats as rs
    wide = rs(tenmin_regular(Tables(spark, sf_dir)), (144, 720), exact_scale=4, block_size=1440, freq="10min")
    long = wide.selectExpr("unique_id", "ds", "y",
                           "stack(2, 144, rolling_mean_144, rolling_std_144, "
                           "720, rolling_mean_720, rolling_std_720) AS (window, rolling_mean, rolling_std)")
    return long.withColumn("rolling_std", F.round("rolling_std", 6)).withColumn(
        "window_label", F.format_string("%d days", (F.col("window") / 144).cast("int")))


def _half_up(df: DataFrame) -> DataFrame:
    """Doubles to 5 places by ``floor(x * 1e5 + 0.5) / 1e5``, which any engine computes alike on ties."""
    return df.select(*[(F.floor(F.col(f.name) * 1e5 + 0.5) / 1e5).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields])


@query
def decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive decomposition with period 144."""
    from seriesspark.operators.analysis import seasonal_decompose
    return _half_up(seasonal_decompose(tenmin_regular(Tables(spark, sf_dir)), 144, exact_scale=4))


@query
def acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation to lag 14."""
    from seriesspark.operators.analysis import acf as acf_
    return round_doubles(acf_(tenmin_regular(Tables(spark, sf_dir)), 14))


@query
def acf_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D27 on 1-day blocks with a 14-step halo; same rows as ``acf``."""
    from seriesspark.operators.analysis import acf as acf_
    return round_doubles(acf_(tenmin_regular(Tables(spark, sf_dir)), 14, block_size=144, freq="10min"))


@query
def decompose_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W16 with the trend window on 2-day blocks (72-step halos both ways)."""
    from seriesspark.operators.analysis import seasonal_decompose
    return _half_up(seasonal_decompose(tenmin_regular(Tables(spark, sf_dir)), 144, block_size=288, freq="10min", exact_scale=4))


@query
def pacf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial autocorrelation to lag 14 (Durbin-Levinson on the ACF array)."""
    from seriesspark.operators.analysis import pacf as pacf_
    return round_doubles(pacf_(tenmin_regular(Tables(spark, sf_dir)), 14), 5)


@query
def pacf_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D27 from the ACF on 1-day blocks; same rows as ``pacf``."""
    from seriesspark.operators.analysis import pacf as pacf_
    return round_doubles(pacf_(tenmin_regular(Tables(spark, sf_dir)), 14, block_size=144, freq="10min"), 5)


@query
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation matrix of all 10-minute series."""
    from seriesspark.operators.analysis import corr_matrix as cm
    return round_doubles(cm(tenmin_regular(Tables(spark, sf_dir))))


@query
def corr_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series most correlated with the 'click' series."""
    from seriesspark.operators.analysis import top_correlations
    return round_doubles(top_correlations(tenmin_regular(Tables(spark, sf_dir)), "click", 10))


@query
def wide_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per 10-minute stamp, one column per series."""
    from seriesspark.operators.analysis import wide_panel as wp
    return wp(tenmin_regular(Tables(spark, sf_dir)))


@query
def series_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and observations per daily series, at least 12 rows."""
    from seriesspark.operators.analysis import series_lengths as sl
    return sl(b.daily_panel(Tables(spark, sf_dir)), min_length=12)


@query
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30-bin histogram of daily series lengths."""
    from seriesspark.operators.analysis import histogram, series_lengths as sl
    lengths = sl(b.daily_panel(Tables(spark, sf_dir))).withColumn("n_rows", F.col("n_rows").cast("double"))
    return round_doubles(histogram(lengths, "n_rows", 30))


@query
def series_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-seller ordered target array and covariate map (arrays as text)."""
    from seriesspark.operators.analysis import series_records as sr
    covs = ["order_count", "avg_price", "avg_freight", "avg_delivery_days", "avg_review_score"]
    rec = sr(seller_panel(Tables(spark, sf_dir), 8), "revenue", covs, SELLER, element_type="double")
    txt = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.6f", x)), ",")
    return rec.select("seller_id", txt(F.col("target")).alias("target"),
                      *[txt(F.col("past_covariates")[c]).alias(c) for c in covs])


# ------------------------------------------------------------ windows and cross validation

L_WIN, H_WIN = 12, 3


def _fmt_array(c):
    return F.array_join(F.transform(c, lambda x: F.format_string("%.6f", x)), ",")


def _seller_y(t: Tables) -> DataFrame:
    return seller_panel(t, 8).select("seller_id", "month", "revenue")


@query
def window_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 12-in / 3-out window of every seller (arrays as text)."""
    from seriesspark.operators.windows import window_arrays as wa
    arr = wa(_seller_y(Tables(spark, sf_dir)), L_WIN, H_WIN, 1, SELLER, element_type="double")
    return arr.select("seller_id", "cutoff", _fmt_array(F.col("input")).alias("input"),
                      _fmt_array(F.col("output")).alias("output"))


@query
def window_arrays_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11 on 24-month blocks with look-back/look-ahead halos; same rows as ``window_arrays``."""
    from seriesspark.operators.windows import window_arrays as wa
    arr = wa(_seller_y(Tables(spark, sf_dir)), L_WIN, H_WIN, 1, SELLER, element_type="double",
             block_size=24, freq="MS")
    return arr.select("seller_id", "cutoff", _fmt_array(F.col("input")).alias("input"),
                      _fmt_array(F.col("output")).alias("output"))


@query
def window_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows stacked into labelled long rows."""
    from seriesspark.operators.windows import window_arrays as wa, windows_long
    arr = wa(_seller_y(Tables(spark, sf_dir)), L_WIN, H_WIN, 1, SELLER, element_type="double")
    return windows_long(arr, L_WIN, "MS", SELLER)


@query
def window_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same long windows through a bounded range join on (id, rn)."""
    from seriesspark.operators.windows import windows_range_join
    return windows_range_join(_seller_y(Tables(spark, sf_dir)), L_WIN, H_WIN, 1, SELLER)


@query
def sequence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """input/target sequence pairs keyed by (seller, cutoff), from the long layout (values in thousandths)."""
    from seriesspark.operators.windows import sequence_pairs as sp, windows_range_join
    long = windows_range_join(_seller_y(Tables(spark, sf_dir)), L_WIN, H_WIN, 1, SELLER)
    pairs = sp(long, L_WIN, H_WIN, SELLER)
    return pairs.select("seller_id", "cutoff", *[
        F.array_join(F.transform(F.col(c), lambda x: F.floor(x.cast("double") * 1000 + 0.5).cast("string")), ",").alias(c)
        for c in ("input", "output")])


N_WINDOWS = 4


def _seller_cv(t: Tables) -> DataFrame:
    from seriesspark.operators.forecast import cross_validation
    return cross_validation(_seller_y(t), H_SELLER, N_WINDOWS, "MS", H_SELLER,
                            ("Naive", "SeasonalNaive"), M_SELLER, SELLER)


@query
def cv_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling-origin CV of both closed-form models, 4 windows, no refit."""
    return _seller_cv(Tables(spark, sf_dir))


@query
def cv_naive_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W14 with grid positions and time-blocked window summaries; same rows as ``cv_naive``."""
    from seriesspark.operators.forecast import cross_validation
    return cross_validation(_seller_y(Tables(spark, sf_dir)), H_SELLER, N_WINDOWS, "MS", H_SELLER,
                            ("Naive", "SeasonalNaive"), M_SELLER, SELLER, block_size=24)


@query
def cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics per (seller, cutoff), averaged by metric."""
    from seriesspark.operators.evaluation import evaluate, summarize
    ev = evaluate(_seller_cv(Tables(spark, sf_dir)), ["Naive", "SeasonalNaive"],
                  ("mae", "mape", "rmse", "smape"), SELLER, extra_keys=("cutoff",))
    return round_doubles(summarize(ev, ["Naive", "SeasonalNaive"]))


@query
def cv_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling-origin CV of Holt-Winters and ADIDA from the fold's state at each cutoff, no refit."""
    from seriesspark.operators.smoothing import smoothing_cv
    panel = _seller_y(Tables(spark, sf_dir))
    hw, ad = (smoothing_cv(panel, H_SELLER, N_WINDOWS, m, H_SELLER, M_SELLER, SELLER) for m in ("HoltWinters", "ADIDA"))
    return round_doubles(hw.join(ad.drop("revenue"), ["seller_id", "month", "cutoff"]))


@query
def cv_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling-origin CV of a linear model on the last value, folded from each cutoff's state."""
    from seriesspark.operators.ml import linear_cross_validation
    cv = linear_cross_validation(daily_filled(Tables(spark, sf_dir)), H_DAILY, N_WINDOWS, "D", [1])
    return round_doubles(cv, 3)


@query
def cv_short_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series that cross validation leaves out, with the rows they would need."""
    from seriesspark.operators.forecast import short_series
    return short_series(b.daily_panel(Tables(spark, sf_dir)), H_DAILY, 76)


@query
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per seller the model with the lowest CV MAE, refit on all rows and forecast."""
    from seriesspark.operators.evaluation import best_model as bm, evaluate
    from seriesspark.operators.forecast import closed_form_forecast, to_long
    t = Tables(spark, sf_dir)
    models = ["Naive", "SeasonalNaive"]
    ev = evaluate(_seller_cv(t), models, ("mae",), SELLER, extra_keys=("cutoff",))
    per = (ev.groupBy("seller_id").agg(*[F.avg(m).alias(m) for m in models])
           .unpivot("seller_id", models, "model", "value"))
    choice = bm(per, "seller_id")
    fc = to_long(closed_form_forecast(_seller_y(t), H_SELLER, "MS", models, M_SELLER, cols=SELLER), models, SELLER)
    out = fc.join(choice, "seller_id").filter(F.col("model") == F.col("best_model"))
    return round_doubles(out.select("seller_id", "month", "best_model", F.col("best_value").alias("cv_mae"), "yhat"))


def registry(h: int, freq: str, m: int, cols: Cols) -> dict:
    """Per model name its cross validation and its forecast, each a function of the history."""
    from seriesspark.operators.forecast import closed_form_forecast, cross_validation, to_long
    from seriesspark.operators.smoothing import adida as ad, holt_winters as hw, smoothing_cv

    def closed(name):
        return (lambda df: cross_validation(df, h, N_WINDOWS, freq, h, (name,), m, cols),
                lambda df: to_long(closed_form_forecast(df, h, freq, (name,), m, cols=cols), (name,), cols))

    return {"Naive": closed("Naive"), "SeasonalNaive": closed("SeasonalNaive"),
            "HoltWinters": (lambda df: smoothing_cv(df, h, N_WINDOWS, "HoltWinters", h, m, cols), lambda df: hw(df, h, freq, m, cols)),
            "ADIDA": (lambda df: smoothing_cv(df, h, N_WINDOWS, "ADIDA", h, m, cols), lambda df: ad(df, h, freq, cols))}


@query
def best_model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12 over all four models: choice by CV MAE, refit and forecast in one plan."""
    from seriesspark.operators.evaluation import choose_and_forecast
    models = registry(H_SELLER, "MS", M_SELLER, SELLER)
    return round_doubles(choose_and_forecast(_seller_y(Tables(spark, sf_dir)), models, "mae", SELLER), 4)


# ------------------------------------------------------------ hierarchy

H_DAILY = 7


def _hierarchy(t: Tables):
    from seriesspark.operators.hierarchy import build_hierarchy
    tree = b.supplier_tree(t)
    return build_hierarchy(daily_filled(t), tree, ["region", "nation"])


@query
def hier_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total / region / nation / supplier series as a chained rollup."""
    Y, _ = _hierarchy(Tables(spark, sf_dir))
    return Y


@query
def hier_summing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse summing table (node, bottom, weight)."""
    _, S = _hierarchy(Tables(spark, sf_dir))
    return S


def _bottom_naive(t: Tables) -> DataFrame:
    from seriesspark.operators.forecast import closed_form_forecast
    return closed_form_forecast(daily_filled(t), H_DAILY, "D", ("Naive",), 1)


@query
def bottom_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom naive forecasts summed to every node."""
    from seriesspark.operators.hierarchy import bottom_up as bu
    t = Tables(spark, sf_dir)
    _, S = _hierarchy(t)
    return bu(_bottom_naive(t), S, ["Naive"])


def _mint(t: Tables):
    """ADIDA forecasts of every node, their in-sample errors and the MinT-reconciled forecasts."""
    from seriesspark.operators.hierarchy import mint_reconcile
    from seriesspark.operators.smoothing import adida as ad, adida_fitted
    Y, S = _hierarchy(t)
    Y = write_once(Y.select("unique_id", "ds", "y"))  # forecasts and errors read it
    base = write_once(ad(Y, H_DAILY, "D").select("unique_id", "ds", F.col("yhat").alias("ADIDA")))
    resid = adida_fitted(Y).select("unique_id", "ds", (F.col("y") - F.col("ADIDA")).alias("resid"))
    return base, mint_reconcile(base, resid, S, ["ADIDA"]), S


@query
def coherence_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """largest gap between a node and the sum of its bottoms, before and after MinT."""
    from seriesspark.operators.hierarchy import coherence_gap as cg
    base, reconciled, S = _mint(Tables(spark, sf_dir))
    gaps = [cg(f, S, "ADIDA").withColumn("stage", F.lit(name)) for name, f in (("base", base), ("reconciled", write_once(reconciled)))]
    return round_doubles(gaps[0].unionByName(gaps[1]), 4)


@query
def mint_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinT reconciliation of ADIDA forecasts with the shrinkage covariance of their errors."""
    return round_doubles(_mint(Tables(spark, sf_dir))[1], 4)


# ------------------------------------------------------------ classical models

@query
def holt_winters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """additive Holt-Winters, season 12, per seller, as array folds."""
    from seriesspark.operators.smoothing import holt_winters as hw
    train, _ = _seller_split(Tables(spark, sf_dir))
    return round_doubles(hw(train, H_SELLER, "MS", M_SELLER, SELLER))


@query
def smoothing_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80 percent intervals of Holt-Winters and ADIDA."""
    from seriesspark.operators.smoothing import adida as ad, holt_winters as hw
    train, _ = _seller_split(Tables(spark, sf_dir))
    return round_doubles(hw(train, H_SELLER, "MS", M_SELLER, SELLER, [80]).unionByName(ad(train, H_SELLER, "MS", SELLER, [80])), 4)


@query
def smoothing_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: fitted values of Holt-Winters and ADIDA."""
    from seriesspark.operators.smoothing import adida_fitted, holt_winters_fitted
    train, _ = _seller_split(Tables(spark, sf_dir))
    return round_doubles(holt_winters_fitted(train, M_SELLER, SELLER).join(adida_fitted(train, SELLER).drop("revenue"), ["seller_id", "month"]))


@query
def arima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARIMA(1,1,1) per seller from lag moments."""
    from seriesspark.operators.arima import arima as ar
    train, _ = _seller_split(Tables(spark, sf_dir))
    return round_doubles(ar(train, (1, 1, 1), H_SELLER, "MS", SELLER), 3)


@query
def arima_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 with lags from 24-month blocks; same rows as ``arima``."""
    from seriesspark.operators.arima import arima as ar
    train, _ = _seller_split(Tables(spark, sf_dir))
    return round_doubles(ar(train, (1, 1, 1), H_SELLER, "MS", SELLER, 24), 3)


@query
def auto_arima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARIMA order (p, q up to 5, d up to 2) by AICc per seller, from one set of moments per d."""
    from seriesspark.operators.arima import auto_arima as aa
    train, _ = _seller_split(Tables(spark, sf_dir))
    return round_doubles(aa(train, H_SELLER, "MS", SELLER), 3)


@query
def own_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own functions per seller in a grouped map."""
    from seriesspark.operators.solvers import forecast_grouped
    train, _ = _seller_split(Tables(spark, sf_dir))
    own = {"Last": lambda y, h: [y[-1]] * h, "Drift": lambda y, h: [y[-1] + (k + 1) * (y[-1] - y[0]) / (len(y) - 1) for k in range(h)]}
    return round_doubles(forecast_grouped(train, H_SELLER, "MS", own, cols=SELLER), 4)


@query
def adida(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ADIDA on the intermittent daily supplier demand, as array folds."""
    from seriesspark.operators.smoothing import adida as ad
    return round_doubles(ad(daily_filled(Tables(spark, sf_dir)), H_DAILY, "D"))


@query
def classic_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dict of models, one forecast column per model."""
    from seriesspark.operators.forecast import closed_form_forecast, forecast_models, to_long
    from seriesspark.operators.smoothing import adida as ad, holt_winters as hw
    train, _ = _seller_split(Tables(spark, sf_dir))

    def closed(name):
        return lambda df: to_long(closed_form_forecast(df, H_SELLER, "MS", (name,), M_SELLER, cols=SELLER), (name,), SELLER)

    models = {"Naive": closed("Naive"), "SeasonalNaive": closed("SeasonalNaive"),
              "HoltWinters": lambda df: hw(df, H_SELLER, "MS", M_SELLER, SELLER), "ADIDA": lambda df: ad(df, H_SELLER, "MS", SELLER)}
    return round_doubles(forecast_models(cut_lineage(train), models, SELLER))  # every model reads the history


@query
def stl_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STL trend/seasonal (season 3) for history and 3 future months, as weighted sums."""
    from seriesspark.operators.stl import stl_features as stl
    return round_doubles(stl(_seller_y(Tables(spark, sf_dir)), 3, 3, "MS", SELLER), 5)


@query
def stl_features_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W17 on 30-month blocks; same rows as ``stl_features``."""
    from seriesspark.operators.stl import stl_features as stl
    return round_doubles(stl(_seller_y(Tables(spark, sf_dir)), 3, 3, "MS", SELLER, 30), 5)


# ------------------------------------------------------------ global models

CANON_FEATURES = ["lag1", "lag2", "lag3", "lag7", "lag14", "lag30", "lag360", "expanding_mean_lag7",
                  "rolling_mean_lag14_window_size7", "rolling_mean_lag30_window_size14"]


def _canon_split(t: Tables):
    """Feature rows split so the last 7 days of each supplier are the holdout (Q1 fixed)."""
    from seriesspark.operators.split import label_holdout
    feats = lag_features(t.spark, t.sf_dir)
    lab = label_holdout(feats, H_DAILY)
    return lab.filter(F.col("split") == "train").drop("split"), lab.filter(F.col("split") == "test").drop("split")


@query
def linear_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """least-squares fit of demand on its 7-day lag (closed form aggregate)."""
    from seriesspark.operators.ml import linear_one_feature as lof
    return round_doubles(lof(lag_features(spark, sf_dir), "lag7", "y"))


@query
def linear_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLlib linear regression on the canonical features; holdout scored."""
    from seriesspark.operators.ml import fit, score
    train, test = _canon_split(Tables(spark, sf_dir))
    model = fit(train, CANON_FEATURES, "linear")
    return score(model, test).select("unique_id", "ds", "y", F.round("prediction", 3).alias("prediction"))


@query
def gbt_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boosted trees (depth 5, step 0.05, 0.9 feature subset, seeded)."""
    from seriesspark.operators.ml import fit, score
    train, test = _canon_split(Tables(spark, sf_dir))
    model = fit(train, CANON_FEATURES, "gbt", max_iter=30)
    return score(model, test).select("unique_id", "ds", "y", "prediction")


@query
def recursive_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: 7-step recursive prediction of the linear model, folded over each supplier's tail."""
    from seriesspark.operators.ml import fit, recursive_forecast as rf
    t = Tables(spark, sf_dir)
    model = fit(lag_features(spark, sf_dir), CANON_FEATURES, "linear")
    return round_doubles(rf(model, daily_filled(t), H_DAILY, "D", [1, 2, 3, 7, 14, 30, 360], [7], {14: 7, 30: 14}), 3)


@query
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save the fitted pipeline to the shared folder, load it, score the holdout."""
    import os
    import uuid

    from seriesspark.operators.ml import fit, save_and_load, score
    from seriesspark.session import checkpoint_dir
    train, test = _canon_split(Tables(spark, sf_dir))
    path = os.path.join(checkpoint_dir(spark), "models", f"linear-{uuid.uuid4().hex}")
    model = save_and_load(fit(train, CANON_FEATURES, "linear"), path)
    return score(model, test).select("unique_id", "ds", "y", F.round("prediction", 3).alias("prediction"))


@query
def recursive_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed linear rule, recursive over 7 days, on the differenced
    target with a future exogenous count and a calendar feature."""
    from seriesspark.operators.ml import recursive_forecast as rf
    from seriesspark.operators.split import train_test
    t = Tables(spark, sf_dir)
    train, _ = train_test(daily_filled(t), H_DAILY)
    lines = (t["lineitem"].groupBy(F.col("l_suppkey").cast("string").alias("unique_id"), F.col("l_shipdate").alias("ds"))
             .agg(F.count(F.lit(1)).cast("double").alias("n_lines")))
    rule = lambda f: f.withColumn("prediction", 0.5 * F.col("lag1") - 0.25 * F.col("lag2")
                                  + 0.125 * F.coalesce("n_lines", F.lit(0.0)) + 0.0625 * F.col("quarter"))
    return round_doubles(rf(rule, train, H_DAILY, "D", [1, 2], X_df=lines, date_features=["quarter"], differences=[1]), 4)


@query
def knn_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 5-nearest-neighbour regression of the holdout."""
    from seriesspark.operators.ml import knn_regress
    from seriesspark.operators.split import label_holdout
    feats = ["lag1", "lag7", "lag14", "expanding_mean_lag7"]
    rows = write_once(label_holdout(lag_features(spark, sf_dir), H_DAILY).select("unique_id", "ds", "y", *feats, "split"))  # the operator reads both parts more than once
    train, test = rows.filter(F.col("split") == "train").drop("split"), rows.filter(F.col("split") == "test").drop("split")
    return round_doubles(knn_regress(train, test, feats, 5, "y", ["unique_id", "ds"]).select("unique_id", "ds", "y", "knn"))


@query
def scoring_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving payload JSON of each supplier's first two feature rows, parsed back."""
    from seriesspark.operators.ml import parse_payload, scoring_payload as sp
    from seriesspark.operators.split import head_per_series
    rows = head_per_series(lag_features(spark, sf_dir), 2)
    back = parse_payload(sp(rows, CANON_FEATURES, "unique_id", ["ds"]))
    return back.select("unique_id", "pos", F.array_join("columns", ",").alias("columns"), _fmt_array(F.col("values")).alias("values"))


@query
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five supplier ids chosen by a seeded hash (reproducible under any partitioning)."""
    return rel.sample_ids(b.daily_panel(Tables(spark, sf_dir)), "unique_id", 5, 4)


@query
def forecast_table_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL table function forecasting each group up to a horizon date."""
    from seriesspark.operators.sqlfn import register_forecast_table
    from seriesspark.session import shuffle_partitions
    register_forecast_table(spark)
    # dealt as PARTITION BY deals a table, so that only sparse rows are shuffled and sorted, not the grid's
    daily_filled(Tables(spark, sf_dir), shuffle_partitions(spark)).createOrReplaceTempView("daily_panel_view")
    return round_doubles(spark.sql("""
        SELECT * FROM ts_forecast(
          TABLE(SELECT unique_id, ds, y FROM daily_panel_view) PARTITION BY unique_id ORDER BY ds,
          horizon => '2001-11-12', frequency => 'D', prediction_interval_width => 0.8,
          time_col => 'ds', value_col => 'y', group_col => 'unique_id')"""))


@query
def forecast_table_fn_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL table function with another model and a monthly grid."""
    from seriesspark.operators.sqlfn import register_forecast_table
    register_forecast_table(spark)
    train, _ = _seller_split(Tables(spark, sf_dir))
    train.createOrReplaceTempView("seller_train_view")
    return round_doubles(spark.sql("""
        SELECT * FROM ts_forecast(
          TABLE(SELECT seller_id, month, revenue FROM seller_train_view) PARTITION BY seller_id ORDER BY month,
          horizon => '2001-12-01', frequency => 'MS', time_col => 'month', value_col => 'revenue', group_col => 'seller_id',
          model => 'SeasonalNaive', season_length => 12)"""))


# ------------------------------------------------------------ small relational operators

@query
def item_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection, computed/renamed/cast/dropped columns via a view."""
    t = Tables(spark, sf_dir)
    t["lineitem"].createOrReplaceTempView("lineitem_scan")
    df = spark.sql("""
        SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(l_quantity AS INT) AS qty,
               l_extendedprice + round(l_extendedprice * l_tax, 4) AS item_total,
               round(sqrt(abs(l_extendedprice)), 6) AS price_sqrt,
               CAST(floor(l_discount * 100) AS BIGINT) AS discount_pct,
               greatest(l_tax, l_discount) AS max_rate, 'item' AS kind, l_returnflag
        FROM lineitem_scan WHERE l_quantity > 0""")
    return df.drop("l_returnflag")


@query
def event_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two types after a date, first 100 in time order."""
    from seriesspark.sources.tables import head
    ev = Tables(spark, sf_dir)["events"]
    sl = ev.filter(F.col("event_type").isin("click", "view")
                   & (F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")))
    return head(sl.select("event_id", "ts", "event_type", "value"), 100, "ts", "event_id")


@query
def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient parse (invalid text to NULL) and strict parse of valid text."""
    ev = Tables(spark, sf_dir)["events"]
    txt = F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = ev.select("event_id", txt.alias("ts_text"))
    return df.select("event_id", F.try_to_timestamp("ts_text").cast("timestamp_ntz").alias("lenient"),
                     F.when(F.col("ts_text") != "not a time",
                            F.to_timestamp("ts_text", "yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("strict"))


@query
def calendar_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-start calendar over the order dates with calendar features."""
    from seriesspark.functions.frequency import date_range, days_in_month, month_start
    o = Tables(spark, sf_dir)["orders"]
    lo = o.select(F.min(month_start("o_orderdate"))).scalar()
    hi = o.select(F.max(month_start("o_orderdate"))).scalar()
    cal = spark.range(1).select(F.explode(date_range(lo, hi, "MS")).alias("month"))
    return cal.select("month", F.quarter("month").alias("quarter"), days_in_month("month").alias("daysinmonth"))


@query
def panel_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, bounds, axis range and first id of the seller panel."""
    p = seller_panel(Tables(spark, sf_dir), 8)
    return round_doubles(p.agg(F.countDistinct("seller_id").alias("n_series"), F.count(F.lit(1)).alias("n_rows"),
                               F.min("month").alias("first_month"), F.max("month").alias("last_month"),
                               F.greatest(F.lit(0.0), F.min("revenue") * 0.9).alias("axis_min"),
                               (F.max("revenue") * 1.1).alias("axis_max"),
                               F.min("seller_id").alias("first_seller")))


@query
def ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered 90/10 split of every daily series."""
    from seriesspark.operators.split import ordered_split as osplit
    return osplit(daily_filled(Tables(spark, sf_dir)), 0.9).select("unique_id", "ds", "split")


@query
def ordered_split_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W15 with grid positions (no whole-series window); same rows as ``ordered_split``."""
    from seriesspark.operators.split import ordered_split as osplit
    return osplit(daily_filled(Tables(spark, sf_dir)), 0.9, freq="D").select("unique_id", "ds", "split")


@query
def first_n_per_series_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 with grid positions; same rows as ``first_n_per_series``."""
    from seriesspark.operators.split import head_per_series
    panel = seller_panel(Tables(spark, sf_dir), 8).select("seller_id", "month", "revenue")
    return head_per_series(panel, 2, SELLER, freq="MS")


@query
def row_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel rows not in the holdout (anti-join on id and time)."""
    train_test_panel = _seller_y(Tables(spark, sf_dir))
    _, test = _seller_split(Tables(spark, sf_dir))
    return rel.anti_join(train_test_panel, test.select("seller_id", "month"), ["seller_id", "month"])


@query
def model_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics per seller and model, long."""
    from seriesspark.functions.metrics import METRICS
    from seriesspark.operators.forecast import closed_form_forecast, to_long
    train, test = _seller_split(Tables(spark, sf_dir))
    models = ("Naive", "SeasonalNaive")
    long = to_long(closed_form_forecast(train, H_SELLER, "MS", models, M_SELLER, cols=SELLER), models, SELLER)
    j = rel.natural_join(test, long)
    y, yhat = F.col("revenue"), F.col("yhat")
    agg = j.groupBy("seller_id", "model").agg(*[fn(y, yhat).alias(n) for n, fn in METRICS.items()])
    names = list(METRICS)
    stacked = agg.selectExpr("seller_id", "model",
                             f"stack({len(names)}, " + ", ".join(f"'{n}', `{n}`" for n in names) + ") AS (metric, value)")
    return round_doubles(stacked)


@query
def exog_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Future exogenous values (line counts) attached to the 7-day horizon rows."""
    from seriesspark.operators.features import join_future_exog
    from seriesspark.operators.grid import horizon_grid
    from seriesspark.operators.split import train_test
    t = Tables(spark, sf_dir)
    lines = (t["lineitem"].groupBy(F.col("l_suppkey").cast("string").alias("unique_id"), F.col("l_shipdate").alias("ds"))
             .agg(F.count(F.lit(1)).alias("n_lines")))
    train, _ = train_test(daily_filled(t), H_DAILY)
    last = train.groupBy("unique_id").agg(F.max("ds").alias("_last_ds"))
    hz = horizon_grid(last, H_DAILY, "D").select("unique_id", "ds", "k")
    return join_future_exog(hz, lines).withColumnRenamed("_missing_exog", "missing_exog")


# ------------------------------------------------------------ sinks, sources, display frame

def _run_folder(spark: SparkSession) -> str:
    import uuid

    from seriesspark.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/runs/{uuid.uuid4().hex}"


@query
def artifact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holdout written as run artifact and as replaced table of a new schema, both read back."""
    from seriesspark.sources.sinks import create_schema, replace_table, write_artifact
    train, test = _seller_split(Tables(spark, sf_dir))
    folder = _run_folder(spark)
    path = write_artifact(test, folder, "test")
    create_schema(spark, "seriesspark_out")
    name = f"seriesspark_out.train_{folder.rpartition('/')[2]}"
    replace_table(train, name, path=f"{folder}/train")
    back = spark.read.parquet(path).withColumn("part", F.lit("test"))
    return back.unionByName(spark.table(name).withColumn("part", F.lit("train")))


@query
def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of both approaches appended to a run's metric log and read back."""
    from seriesspark.operators.evaluation import compare_approaches
    from seriesspark.sources.sinks import log_metrics
    train, test = _seller_split(Tables(spark, sf_dir))
    m = round_doubles(compare_approaches(_seller_preds(train), test, "revenue", "seller_id", "month"))
    folder = _run_folder(spark)
    for name in ("Naive", "SeasonalNaive"):
        path = log_metrics(m.where(F.col("approach") == name), folder, "run-1", name)
    return spark.read.parquet(path)


CSV_SUMS = {"orders": "o_totalprice", "lineitem": "l_extendedprice", "customer": "c_custkey", "supplier": "s_suppkey"}


@query
def csv_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact and dimension tables written as CSV, read back as a named set with schemas, profiled, summed and sampled."""
    from seriesspark.sources.tables import read_csv_set, sample_rows, table_profile
    t, folder = Tables(spark, sf_dir), _run_folder(spark)
    for n in CSV_SUMS:
        t[n].write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{folder}/{n}")
    frames = read_csv_set(spark, {n: f"{folder}/{n}" for n in CSV_SUMS}, {n: t[n].schema for n in CSV_SUMS})
    sums = None
    for n, c in CSV_SUMS.items():
        one = frames[n].agg(F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias("total")).withColumn("table", F.lit(n))
        sums = one if sums is None else sums.unionByName(one)
    picked = sample_rows(frames["orders"], 5, 7, "o_orderkey").count()
    return table_profile(frames).join(sums, "table").withColumn("sampled", F.lit(picked))


@query
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and prediction columns unioned into one value column, with the axis range per seller."""
    train, test = _seller_split(Tables(spark, sf_dir))
    j = test.join(_seller_preds(train)["Naive"], ["seller_id", "month"])
    long = j.unpivot(["seller_id", "month"], ["revenue", "predictions"], "kind", "value")
    return round_doubles(long.groupBy("seller_id").agg(F.count("value").alias("n_values"), F.greatest(F.lit(0.0), F.min("value") * 0.9).alias("axis_min"),
                                                       (F.max("value") * 1.1).alias("axis_max")))
