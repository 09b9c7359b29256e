"""Timeframes and the ``as_of`` clock.

Every metric takes an ``as_of`` clock (``None`` = now, UTC) instead of reading the wall clock inside the query, so
all metrics of one request share one clock. Period boundaries are computed once on the driver
as plain datetimes and enter the plan as ``timestamp_ntz`` literals, so Catalyst can push them into the Parquet scan.
Interval arithmetic follows SQL: subtracting months clips to the month end (2024-03-31 minus 1 month = 2024-02-29).
"""

from __future__ import annotations

import calendar
import datetime as dt
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Timeframe(str, Enum):
    DAY = "day"
    WEEK = "week"
    MONTH = "month"

    @classmethod
    def parse(cls, value: "Timeframe | str") -> "Timeframe":
        try:
            return cls(value.value if isinstance(value, Timeframe) else str(value).lower())
        except ValueError:
            raise ValueError(f"timeframe must be one of day, week, month; got {value!r}") from None

    @property
    def retention_scope(self) -> int:
        """Number of cohorts shown by the retention chart."""
        # 14 days, 12 weeks, 6 months.
        return {Timeframe.DAY: 14, Timeframe.WEEK: 12, Timeframe.MONTH: 6}[self]


def now() -> dt.datetime:
    """The wall clock in UTC, as a naive timestamp (the default ``as_of``)."""
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def as_datetime(value: dt.datetime | dt.date | str | None) -> dt.datetime:
    """Normalise a clock value to naive UTC; ``None`` means now. Values with an offset, text too, are converted."""
    if value is None:
        return now()
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return dt.datetime(value.year, value.month, value.day)
    stamp = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))
    return stamp.astimezone(dt.timezone.utc).replace(tzinfo=None) if stamp.tzinfo else stamp


def add_months(ts: dt.datetime, months: int) -> dt.datetime:
    month_index = ts.year * 12 + (ts.month - 1) + months
    year, month = divmod(month_index, 12)
    month += 1
    day = min(ts.day, calendar.monthrange(year, month)[1])
    return ts.replace(year=year, month=month, day=day)


def shift(ts: dt.datetime, n: int, unit: Timeframe | str) -> dt.datetime:
    """``ts + n unit`` with SQL interval semantics."""
    unit = Timeframe.parse(unit)
    if unit is Timeframe.MONTH:
        return add_months(ts, n)
    if unit is Timeframe.WEEK:
        return ts + dt.timedelta(weeks=n)
    return ts + dt.timedelta(days=n)


def truncate(ts: dt.datetime, unit: Timeframe | str) -> dt.datetime:
    """``date_trunc(unit, ts)``; weeks start on Monday."""
    unit = Timeframe.parse(unit)
    day = ts.replace(hour=0, minute=0, second=0, microsecond=0)
    if unit is Timeframe.MONTH:
        return day.replace(day=1)
    if unit is Timeframe.WEEK:
        return day - dt.timedelta(days=day.weekday())
    return day


def ntz(ts: dt.datetime | dt.date | str) -> Column:
    """A ``timestamp_ntz`` literal (constant-folded; pushes down to Parquet)."""
    return F.lit(as_datetime(ts).isoformat(sep=" ")).cast("timestamp_ntz")


def period_start(col: Column | str, unit: Timeframe | str) -> Column:
    """``date_trunc(unit, col)`` kept as ``timestamp_ntz`` (session zone is UTC)."""
    name = "hour" if unit == "hour" else Timeframe.parse(unit).value
    c = F.col(col) if isinstance(col, str) else col
    return F.date_trunc(name, c).cast("timestamp_ntz")
