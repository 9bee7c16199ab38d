"""SQL table-valued forecast function.

``ts_forecast(TABLE(...) PARTITION BY grp ORDER BY ds, horizon => ..., frequency
=> ..., prediction_interval_width => ..., time_col => ..., value_col => ...,
group_col => ..., model => ..., season_length => ...)``: Spark partitions and sorts
the table by group; the function gets a group's rows in time order as Arrow batches
and keeps its last ``season_length`` values, the sum of squared in-sample errors and
their number, so no group is held in memory and no Python runs per row. At the end
of a group it emits the forecast with a normal interval for every grid point strictly
after the last ``ds`` and strictly before ``horizon``.

Models: ``Naive`` (default) and ``SeasonalNaive``, as in ``forecast``. NULL values are
skipped. ``frequency`` is D, H, W (seven days), MS or any pandas frequency. A group
without values, or shorter than its season, gives no rows; one without an error has
NaN bounds.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

ALIASES = {"d": "D", "H": "h", "W": "7D"}
MODELS = ("Naive", "SeasonalNaive")
SCHEMA = pa.schema([("grp", pa.string()), ("ds", pa.timestamp("us")), ("forecast", pa.float64()), ("lower", pa.float64()), ("upper", pa.float64())])


@arrow_udtf(returnType="grp string, ds timestamp_ntz, forecast double, lower double, upper double")
class TsForecast:
    def __init__(self):
        self.grp = self.args = self.last_ds = None
        self.tail, self.ss, self.n = np.zeros(0), 0.0, 0

    def eval(self, rows, horizon, frequency="D", prediction_interval_width=0.8, time_col="ds", value_col="y", group_col="grp",
             model="Naive", season_length=1):
        one = lambda v: v[0].as_py() if isinstance(v, (pa.Array, pa.ChunkedArray)) else v
        if not len(rows):
            return iter(())
        model, m = one(model), int(one(season_length))
        if model not in MODELS:
            raise ValueError(f"unknown model {model!r}, one of {MODELS}")
        m = 1 if model == "Naive" else m
        self.args = (str(one(horizon)), one(frequency), float(one(prediction_interval_width)), m)
        values = pc.cast(rows.column(one(value_col)), pa.float64(), safe=False)
        whole = values.is_valid()
        self.grp = str(rows.column(one(group_col))[0].as_py())
        stamps = rows.column(one(time_col)).filter(whole)
        if len(stamps):
            y = np.concatenate([self.tail, values.filter(whole).to_numpy(zero_copy_only=False)])
            errors = y[m:] - y[:-m]
            self.ss, self.n = self.ss + float(errors @ errors), self.n + len(errors)
            self.tail, self.last_ds = y[-m:], stamps[-1].as_py()
        return iter(())

    def terminate(self):
        if self.last_ds is None:
            return
        horizon, frequency, width, m = self.args
        last = pd.Timestamp(self.last_ds).tz_localize(None)
        grid = pd.date_range(last, pd.Timestamp(horizon), freq=ALIASES.get(frequency, frequency), inclusive="left")
        grid = grid[grid > last]
        if len(self.tail) < m or not len(grid):
            return
        k = np.arange(1, len(grid) + 1)
        point = self.tail[(k - 1) % m]
        sigma = math.sqrt(self.ss / self.n) if self.n else float("nan")
        spread = NormalDist().inv_cdf(0.5 + width / 2.0) * sigma * np.sqrt((k - 1) // m + 1)
        yield pa.table([pa.array([self.grp] * len(grid)), pa.array(grid.to_numpy("datetime64[us]")), pa.array(point), pa.array(point - spread), pa.array(point + spread)], schema=SCHEMA)


def register_forecast_table(spark: SparkSession, name: str = "ts_forecast") -> None:
    spark.udtf.register(name, TsForecast)
