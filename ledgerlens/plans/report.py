"""Daily economic report over a date range."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..operators.report import daily_report
from ..sources.registry import Tables
from ..timeframe import as_datetime


def report(tables: Tables, start: dt.date | str, end: dt.date | str, as_of=None) -> DataFrame:
    """``day, l2_gas_rev, l1_messaging_rev, l1_batch_posting_cost, l1_batch_verification_cost, l1_gas_oracle_cost,
    l2_gas_oracle_cost, total_revenue, total_cost, l2_transaction_quantity`` for the days of ``[start, end]`` that
    have fee revenue. ``end`` is midnight at the start of that date. Totals are NULL when the bridge revenue, batch
    or verification cost of the day is missing; oracle costs count as 0 when missing."""
    t = tables.as_of(as_datetime(as_of)) if as_of is not None else tables
    return daily_report(t.window(start, end), start, end)


def dashboard(tables: Tables, start, end, as_of=None) -> dict[str, DataFrame]:
    return {"report": report(tables, start, end, as_of)}
