"""Error metrics as aggregate Column builders.

Every builder takes the actual and forecast columns and returns an aggregate
expression, so any set of metrics runs in one ``groupBy().agg()``. Rows with
a NULL actual or forecast are excluded. Definitions (fixed here, since the
reference delegates them to libraries):

* ``mae``   = avg(abs(e)),  e = y - yhat
* ``rmse``  = sqrt(avg(e * e))
* ``mape``  = avg(abs(e) / abs(y)) over y <> 0 (a fraction, not percent);
  ``mape_pos`` restricts to y > 0 (the masked variant)
* ``smape`` = avg(abs(e) / (abs(y) + abs(yhat))), 0/0 counted as 0 (0..1)
* ``bias``  = avg(e)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _both(y: Column, yhat: Column) -> Column:
    return y.isNotNull() & yhat.isNotNull()


def mae(y, yhat) -> Column:
    y, yhat = _c(y), _c(yhat)
    return F.avg(F.abs(y - yhat))


def rmse(y, yhat) -> Column:
    y, yhat = _c(y), _c(yhat)
    return F.sqrt(F.avg((y - yhat) * (y - yhat)))


def mape(y, yhat) -> Column:
    y, yhat = _c(y), _c(yhat)
    return F.avg(F.when(y != 0, F.abs(y - yhat) / F.abs(y)))


def mape_pos(y, yhat) -> Column:
    y, yhat = _c(y), _c(yhat)
    return F.avg(F.when(y > 0, F.abs(y - yhat) / y))


def smape(y, yhat) -> Column:
    y, yhat = _c(y), _c(yhat)
    den = F.abs(y) + F.abs(yhat)
    return F.avg(F.when(_both(y, yhat), F.when(den == 0, F.lit(0.0)).otherwise(F.abs(y - yhat) / den)))


def bias(y, yhat) -> Column:
    y, yhat = _c(y), _c(yhat)
    return F.avg(y - yhat)


# Metric names accepted by the evaluation operators.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "mae": mae,
    "rmse": rmse,
    "mape": mape,
    "mape_pos": mape_pos,
    "smape": smape,
    "bias": bias,
}


def resolve(metrics) -> dict[str, Callable]:
    """Accept names or ``(name, builder)`` pairs (user-supplied metrics, U2)."""
    out = {}
    for m in metrics:
        if isinstance(m, str):
            out[m] = METRICS[m]
        elif isinstance(m, tuple):
            out[m[0]] = m[1]
        else:
            out[m.__name__] = m
    return out
