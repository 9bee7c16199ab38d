"""Frequency codes (X6) and calendar helpers.

Frequency is always an explicit argument and is validated: daily data is never
silently treated as month-start data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequency codes the library accepts and the interval each means.
FREQ_INTERVALS = {
    "D": "1 DAY",
    "d": "1 DAY",
    "MS": "1 MONTH",
    "H": "1 HOUR",
    "h": "1 HOUR",
    "10min": "10 MINUTES",
    "min": "1 MINUTE",
    "W": "7 DAYS",
}


def interval_literal(freq: str) -> str:
    try:
        return FREQ_INTERVALS[freq]
    except KeyError:
        raise ValueError(f"unsupported frequency {freq!r}; use one of {sorted(FREQ_INTERVALS)}") from None


def interval(freq: str, times: int = 1) -> Column:
    """Interval column for ``times`` steps of ``freq``."""
    amount, unit = interval_literal(freq).split(" ", 1)
    return F.expr(f"INTERVAL {int(amount) * int(times)} {unit}")


def step_forward(ds: Column | str, k: Column | int, freq: str) -> Column:
    """``ds + k * freq`` for a column or literal ``k``."""
    ds = F.col(ds) if isinstance(ds, str) else ds
    amount, unit = interval_literal(freq).split(" ", 1)
    k = F.lit(k) if isinstance(k, int) else k
    n = (k * F.lit(int(amount))).cast("int")
    unit = unit.rstrip("S").upper()
    if unit == "MONTH":
        return F.make_ym_interval(F.lit(0), n) + ds
    if unit == "DAY":
        return ds + F.make_dt_interval(n)
    if unit == "HOUR":
        return ds + F.make_dt_interval(F.lit(0), n)
    if unit == "MINUTE":
        return ds + F.make_dt_interval(F.lit(0), F.lit(0), n)
    raise ValueError(unit)


def month_start(ts: Column | str) -> Column:
    """Truncate to month start, keeping timestamp_ntz."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc("MONTH", ts).cast("timestamp_ntz")


def date_range(start: Column, end: Column, freq: str) -> Column:
    """Array of grid points from ``start`` to ``end`` inclusive."""
    return F.sequence(start, end, interval(freq))


def quarter(ds: Column | str) -> Column:
    """Calendar quarter 1-4."""
    return F.quarter(ds)


def days_in_month(ds: Column | str) -> Column:
    """Number of days in the month of ``ds``."""
    ds = F.col(ds) if isinstance(ds, str) else ds
    return F.dayofmonth(F.last_day(ds))


def bucket_timestamp(ts: Column | str, freq: str) -> Column:
    """Start of the fixed-width bucket holding ``ts`` (10-minute panel)."""
    return F.window(ts, interval_literal(freq).lower()).start.cast("timestamp_ntz")


# Length in seconds of the fixed-width frequencies.
FREQ_SECONDS = {"D": 86400, "d": 86400, "H": 3600, "h": 3600, "10min": 600, "min": 60, "W": 7 * 86400}


def step_index(ds: Column | str, freq: str) -> Column:
    """Integer position of ``ds`` on the ``freq`` grid counted from the epoch.

    Computed from the row alone (no window), so it can key a partitioning.
    """
    ds = F.col(ds) if isinstance(ds, str) else ds
    if freq == "MS":
        return (F.year(ds) * 12 + F.month(ds) - 1).cast("long")
    secs = F.unix_seconds(ds.cast("timestamp"))
    return F.floor(secs / F.lit(FREQ_SECONDS[freq])).cast("long")
