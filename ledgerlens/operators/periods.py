"""Per-period aggregation (the chart building block).

``period_agg`` groups rows by ``date_trunc(tf, ts)`` and applies the given aggregates. Range predicates are applied
to the raw timestamp (never to the truncated one) so they push down to the scan; Spark plans the aggregate as a
partial (map-side) aggregate, a shuffle of one row per period and task, and a final aggregate. The output has one
row per period, so every later join or window over it is bounded by the calendar.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import period, short_label
from ..timeframe import Timeframe, ntz

PERIOD = "_period"


def period_agg(
    df: DataFrame,
    ts: str,
    tf: Timeframe | str,
    aggs: list[Column],
    before: dt.datetime | None = None,
    since: dt.datetime | None = None,
    until: dt.datetime | None = None,
) -> DataFrame:
    """Aggregate ``df`` per period. Output: ``_period`` (timestamp_ntz) followed by the aggregates.

    ``before`` keeps ``ts < before`` (complete periods), ``since`` keeps ``ts >= since`` and ``until`` keeps
    ``ts <= until`` (closed end, used by the daily report).
    """
    rows = df
    if before is not None:
        rows = rows.filter(F.col(ts) < ntz(before))
    if since is not None:
        rows = rows.filter(F.col(ts) >= ntz(since))
    if until is not None:
        rows = rows.filter(F.col(ts) <= ntz(until))
    return rows.groupBy(period(ts, tf).alias(PERIOD)).agg(*aggs)


def labelled(df: DataFrame, label: str = "date", fmt=short_label, then: tuple[str, ...] = ()) -> DataFrame:
    """Replace ``_period`` by its text label and order by the real period (text ``yy`` order breaks at 2000), then by
    the columns ``then``."""
    others = [col for col in df.columns if col != PERIOD]
    return df.orderBy(PERIOD, *then).select(fmt(F.col(PERIOD)).alias(label), *others)
