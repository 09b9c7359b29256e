"""Trailing-window activity cards: distinct keys in the last ``n`` units and their growth.

Conditional distinct counts are computed in two levels instead of ``count(distinct case ...)`` per window: rows are
reduced to one row per key with a flag per window (partial aggregation before the shuffle, so a hot key sends one
row per task), then the flags are counted. This needs one shuffle of distinct keys however many windows are asked,
where ``count(distinct)`` per window would ``Expand`` every row once per window. A hot key cannot skew it: its rows
are pre-aggregated map-side.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import growth_card
from ..timeframe import Timeframe, ntz, shift


@dataclass(frozen=True)
class Window:
    """The trailing window ``[as_of - n unit, as_of]`` and the one before it, ``[as_of - 2n unit, as_of - n unit)``."""

    n: int
    unit: Timeframe

    def bounds(self, as_of: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
        return shift(as_of, -self.n, self.unit), shift(as_of, -2 * self.n, self.unit)


def activity_flags(df: DataFrame, key: str, ts: str, as_of: dt.datetime, windows: dict[str, Window], with_previous: bool) -> DataFrame:
    """One row per non-NULL key with boolean ``{name}_cur`` / ``{name}_prev`` flags for every window."""
    starts = []
    flags = []
    for name, win in windows.items():
        one_ago, two_ago = win.bounds(as_of)
        starts.append(two_ago if with_previous else one_ago)
        cur = F.col(ts) >= ntz(one_ago)
        flags.append(F.bool_or(cur).alias(f"{name}_cur"))
        if with_previous:
            flags.append(F.bool_or(~cur & (F.col(ts) >= ntz(two_ago))).alias(f"{name}_prev"))
    rows = df.select(key, ts).filter(F.col(key).isNotNull() & (F.col(ts) >= ntz(min(starts))))
    return rows.groupBy(key).agg(*flags)


def trailing_distinct(df: DataFrame, key: str, ts: str, as_of: dt.datetime, n: int, unit: Timeframe | str, out: str = "active_wallets") -> DataFrame:
    """Distinct ``key`` values with ``ts >= as_of - n unit``: one row, one column."""
    start = shift(as_of, -n, Timeframe.parse(unit))
    return df.filter(F.col(ts) >= ntz(start)).agg(F.count_distinct(key).alias(out))


def distinct_growth(df: DataFrame, key: str, ts: str, as_of: dt.datetime, n: int, unit: Timeframe | str, out: str) -> DataFrame:
    """Growth (%) of distinct keys in the last ``n`` units over the ``n`` units before, one decimal; NULL if the
    earlier window is empty."""
    flags = activity_flags(df, key, ts, as_of, {"w": Window(n, Timeframe.parse(unit))}, with_previous=True)
    counts = flags.agg(F.count_if("w_cur").alias("cur"), F.count_if("w_prev").alias("prev"))
    return counts.select(growth_card("cur", "prev").alias(out))


def activity_cards(df: DataFrame, key: str, ts: str, as_of: dt.datetime, windows: dict[str, Window]) -> DataFrame:
    """All cards of a dashboard in one scan and one shuffle: ``actives_{name}`` = distinct keys in the window and
    ``actives_growth_{name}`` = growth over the window before. One row."""
    flags = activity_flags(df, key, ts, as_of, windows, with_previous=True)
    counts = flags.agg(*[F.count_if(f"{name}_{side}").alias(f"{name}_{side}") for name in windows for side in ("cur", "prev")])
    cols = []
    for name in windows:
        cols += [F.col(f"{name}_cur").alias(f"actives_{name}"), growth_card(f"{name}_cur", f"{name}_prev").alias(f"actives_growth_{name}")]
    return counts.select(*cols)
