"""Series operators: row-based rolling mean, first-seen split and multi-series alignment.

All three run on per-period aggregates (one row per period, or per period and series), so their windows and
pivots see calendar-bounded inputs; a window without ``partitionBy`` is a single-partition step over a few hundred
rows, not over facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import NEWLY_ACTIVE, RETURNING, period
from ..timeframe import Timeframe, ntz


def rolling_mean(df: DataFrame, order: str, value: str, n: int = 3, partition: str | None = None, out: str | None = None) -> DataFrame:
    """Mean of ``value`` over the current row and the ``n - 1`` rows before it (by row, not by calendar: a missing
    period is skipped and the first rows average fewer values)."""
    w = Window.orderBy(order).rowsBetween(-(n - 1), Window.currentRow)
    if partition:
        w = Window.partitionBy(partition).orderBy(order).rowsBetween(-(n - 1), Window.currentRow)
    return df.withColumn(out or value, F.avg(value).over(w))


def first_seen_split(df: DataFrame, key: str, ts: str, tf: Timeframe | str, before, compare_unit: Timeframe | str = Timeframe.WEEK) -> DataFrame:
    """Distinct keys per period, split into ``Newly Active Deployer`` (the ``compare_unit`` of the row is the one of
    the key's first row) and ``Returning Deployer``. Output: ``_period, classification, num_accounts``.

    First rows are taken over all history (also the current partial period); output covers ``ts < before``.
    Rows are first reduced to distinct (key, period, compare unit) with map-side aggregation, so the window that
    finds each key's first unit sees at most a calendar's worth of rows per key, however active the key is. Rows without
    a key count no account but keep their period and class.
    """
    tf, unit = Timeframe.parse(tf), Timeframe.parse(compare_unit)
    reduced = df.select(key, period(ts, tf).alias("_period"), period(ts, unit).alias("_unit")).distinct()
    first = F.min("_unit").over(Window.partitionBy(key))
    classified = reduced.withColumn("_first", first).filter(F.col("_period") < ntz(before))
    label = F.when(F.col("_unit") == F.col("_first"), F.lit(NEWLY_ACTIVE)).otherwise(F.lit(RETURNING))
    return classified.groupBy("_period", label.alias("classification")).agg(F.count_distinct(key).alias("num_accounts"))


def align_series(long_df: DataFrame, period_col: str, series_col: str, value_col: str, series: tuple[str, ...]) -> DataFrame:
    """Pivot a long (period, series, value) frame to one column per series, keeping periods present in every
    series (equal to inner-joining the per-series frames on the period)."""
    wide = long_df.groupBy(period_col).pivot(series_col, list(series)).agg(F.first(value_col))
    return wide.dropna(subset=list(series))
