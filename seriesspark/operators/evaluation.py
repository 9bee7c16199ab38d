"""Forecast evaluation.

All metrics of all models are computed in one aggregate per group key; the
per-metric rows are produced afterwards by a narrow ``stack``, so evaluating
many models over many series costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesspark.functions.contracts import DEFAULT, Cols
from seriesspark.functions.metrics import METRICS, resolve
from seriesspark.session import cut_lineage


def calc_metrics(test: DataFrame, pred: DataFrame, target: str, id_col: str, ts_col: str,
                 pred_col: str = "predictions") -> DataFrame:
    """Forecast-to-actual join, then MAE, RMSE, masked MAPE and counts.

    MAPE uses only rows with a positive actual (P10); NULL when there is none.
    """
    m = test.select(id_col, ts_col, target).join(pred.select(id_col, ts_col, pred_col),
                                                  [id_col, ts_col], "inner")
    y, yhat = F.col(target).cast("double"), F.col(pred_col).cast("double")
    return m.agg(METRICS["mae"](y, yhat).alias("mae"),
                 METRICS["rmse"](y, yhat).alias("rmse"),
                 METRICS["mape_pos"](y, yhat).alias("mape"),
                 F.countDistinct(id_col).alias("n_series"),
                 F.count(F.lit(1)).alias("n_predictions"))


def compare_approaches(frames: dict[str, DataFrame], test: DataFrame, target: str, id_col: str,
                       ts_col: str, pred_col: str = "predictions") -> DataFrame:
    """One row of metrics per approach (D20): union of labelled joins, one aggregate."""
    parts = [test.select(id_col, ts_col, target)
             .join(p.select(id_col, ts_col, pred_col), [id_col, ts_col], "inner")
             .withColumn("approach", F.lit(name)) for name, p in frames.items()]
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    y, yhat = F.col(target).cast("double"), F.col(pred_col).cast("double")
    return allp.groupBy("approach").agg(
        METRICS["mae"](y, yhat).alias("mae"), METRICS["rmse"](y, yhat).alias("rmse"),
        METRICS["mape_pos"](y, yhat).alias("mape"),
        F.countDistinct(id_col).alias("n_series"), F.count(F.lit(1)).alias("n_predictions"))


def cross_rows(frames: dict[str, DataFrame], test: DataFrame, target: str, id_col: str,
               ts_col: str, pred_col: str = "predictions") -> DataFrame:
    """Actual-vs-predicted rows of several approaches, labelled."""
    parts = [test.select(id_col, ts_col, target)
             .join(p.select(id_col, ts_col, pred_col), [id_col, ts_col], "inner")
             .withColumn("approach", F.lit(name)) for name, p in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(id_col, ts_col, F.col(target).cast("double").alias(target),
                      F.col(pred_col).cast("double").alias(pred_col), "approach")


def evaluate(df: DataFrame, models, metrics=("mae", "rmse", "mape", "smape"),
             cols: Cols = DEFAULT, extra_keys=()) -> DataFrame:
    """Per series x metric, one column per model.

    Input: ``(id, [extra_keys], ds, y, <model>...)``. Output:
    ``(id, [extra_keys], metric, <model>...)``.
    """
    fns = resolve(metrics)
    keys = [cols.id, *extra_keys]
    y = F.col(cols.y)
    aggs = [fn(y, F.col(m)).alias(f"{name}__{m}") for name, fn in fns.items() for m in models]
    wide = df.groupBy(*keys).agg(*aggs)
    stack = ", ".join(f"'{name}', " + ", ".join(f"`{name}__{m}`" for m in models) for name in fns)
    names = ", ".join(["metric", *[f"`{m}`" for m in models]])
    return wide.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(fns)}, {stack}) AS ({names})")


def summarize(evaluation: DataFrame, models, by=("metric",)) -> DataFrame:
    """Average each model's metric over series (and cutoffs)."""
    return evaluation.groupBy(*by).agg(*[F.avg(F.col(f"`{m}`")).alias(m) for m in models])


def best_model(summary_long: DataFrame, id_col: str, model_col: str = "model",
               value_col: str = "value") -> DataFrame:
    """Model with the lowest error per series, ties by model name."""
    return summary_long.groupBy(id_col).agg(
        F.min_by(F.col(model_col), F.struct(F.col(value_col), F.col(model_col))).alias("best_model"),
        F.min(value_col).alias("best_value"))


def choose_and_forecast(df: DataFrame, models: dict, metric: str = "mae", cols: Cols = DEFAULT) -> DataFrame:
    """Model choice over a registry (F12): ``(id, ds, best_model, cv_<metric>, yhat)``.

    ``models`` maps a name to two functions of the history: cross validation ``(id, ds,
    cutoff, y, <name>)`` and long forecasts ``(id, ds, ..., yhat)`` of all rows. The error is
    the mean over cutoffs of a series' metric, the choice the smallest, ties by name. A
    series that no model could be validated on is left out (``forecast.short_series``).
    """
    from seriesspark.operators.forecast import forecast_models
    df = cut_lineage(df)  # every model reads the history twice
    errors = None
    for name, (validate, _) in models.items():
        part = evaluate(validate(df), [name], (metric,), cols, ("cutoff",)).groupBy(cols.id).agg(F.avg(F.col(f"`{name}`")).alias("value"))
        part = part.withColumn("model", F.lit(name))
        errors = part if errors is None else errors.unionByName(part)
    choice = best_model(errors.where(F.col("value").isNotNull()), cols.id)
    wide = forecast_models(df, {name: forecast for name, (_, forecast) in models.items()}, cols)
    picked = F.coalesce(*[F.when(F.col("best_model") == name, F.col(f"`{name}`")) for name in models])
    return wide.join(choice, cols.id).select(cols.id, cols.ds, "best_model", F.col("best_value").alias(f"cv_{metric}"), picked.alias("yhat"))
