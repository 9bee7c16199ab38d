"""A caller's own forecasting function over many series (U1), and models by name."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesspark.functions.contracts import DEFAULT, Cols
from seriesspark.functions.frequency import step_forward
from seriesspark.operators.arima import arima, auto_arima

MODEL_NAMES = ("ARIMA", "AutoARIMA")


def forecast_grouped(df: DataFrame, h: int, freq: str, models=MODEL_NAMES,
                     arima_order: tuple[int, int, int] = (1, 1, 1), cols: Cols = DEFAULT) -> DataFrame:
    """Long forecasts ``(id, ds, model, yhat)``.

    ``models`` lists names of ``MODEL_NAMES``, computed as Spark expressions, or is a
    dict from a name to a caller's own ``f(y, h) -> h values`` (U1), which gets each
    series as one array in a grouped map: one shuffle by series, a series per task.
    """
    if not isinstance(models, dict):
        named = {"ARIMA": lambda: arima(df, arima_order, h, freq, cols), "AutoARIMA": lambda: auto_arima(df, h, freq, cols).drop("order")}
        out = None
        for name in models:
            out = named[name]() if out is None else out.unionByName(named[name]())
        return out
    id_type = df.schema[cols.id].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cols.ds)
        y = pdf[cols.y].astype(float).fillna(0.0).to_numpy()
        return pd.concat([pd.DataFrame({cols.id: pdf[cols.id].iloc[0], "k": np.arange(1, h + 1), "model": name,
                                        "yhat": np.asarray(f(y, h), dtype=float), "_last_ds": pdf[cols.ds].iloc[-1]})
                          for name, f in models.items()])

    schema = f"{cols.id} {id_type}, k int, model string, yhat double, _last_ds timestamp_ntz"
    res = df.select(cols.id, cols.ds, cols.y).groupBy(cols.id).applyInPandas(solve, schema)
    return res.select(cols.id, step_forward(F.col("_last_ds"), F.col("k"), freq).alias(cols.ds), "model", "yhat")
