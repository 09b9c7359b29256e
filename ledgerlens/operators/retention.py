"""Cohort retention without fact self-joins.

Semantics: a key's cohort is the first period in which it appears (over all history before the current period);
for every cohort that starts within the last ``scope`` complete periods, the chart gives the share of the cohort
active ``k`` periods later, ``k = 0 ..``; offset 0 is always 100.

Plan: a single ``groupBy(key)`` computes, per key, its first period and a bitmask of the in-scope periods in which it
was active (``bit_or`` of one bit per period; ``scope`` is at most 14, so it fits a ``bigint``). Both aggregates are
partial (map-side), so the one large shuffle carries one row per key and task, and a key with a third of all rows
costs no more than any other. Keys whose cohort is in scope are expanded to at most ``scope`` (cohort, offset) rows
and counted; cohort sizes are the offset-0 counts. NULL keys are ignored (they have no activity to follow).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import period, retention_pct, short_label
from ..functions.joins import bounded
from ..timeframe import Timeframe, ntz, shift, truncate


def cohort_retention(df: DataFrame, key: str, ts: str, tf: Timeframe | str, as_of: dt.datetime, scope: int) -> DataFrame:
    tf = Timeframe.parse(tf)
    if not 0 < scope < 63:
        raise ValueError("scope must be between 1 and 62 periods")
    cut = truncate(as_of, tf)
    first = truncate(shift(as_of, -scope, tf), tf)
    unit = tf.value.upper()

    rows = df.select(key, period(ts, tf).alias("p")).filter(F.col(key).isNotNull() & (F.col(ts) < ntz(cut)))
    # Bit i of ``active`` = active in the i-th period of the scope window (earlier periods set no bit).
    bit = F.when(F.col("p") >= ntz(first), F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST(timestampdiff({unit}, {_lit(first)}, p) AS INT))"))
    per_key = rows.groupBy(key).agg(F.min("p").alias("cohort"), F.bit_or(bit).alias("active"))
    in_scope = per_key.filter(F.col("cohort") >= ntz(first)).withColumn(
        "_pos", F.expr(f"CAST(timestampdiff({unit}, {_lit(first)}, cohort) AS INT)")
    )
    # Offsets k whose bit (cohort position + k) is set; at most ``scope`` per key.
    offsets = in_scope.select(
        "cohort",
        F.explode(F.expr(f"filter(sequence(0, {scope - 1} - _pos), k -> (shiftright(active, _pos + k) & 1) = 1)")).alias("k"),
    )
    counts = offsets.groupBy("cohort", "k").agg(F.count(F.lit(1)).alias("num_users"))
    return percentages(counts, tf)


def percentages(counts: DataFrame, tf: Timeframe | str) -> DataFrame:
    """The chart from (cohort, k, num_users): ``cohort, total_users, {tf}_number, percentage``."""
    offset_col = f"{Timeframe.parse(tf).value}_number"
    # One row per cohort in scope: at most ``scope`` rows.
    sizes = bounded(counts.filter(F.col("k") == 0).select("cohort", F.col("num_users").alias("total_users")))
    return (
        counts.join(sizes, "cohort")
        .orderBy("cohort", "k")
        .select(
            short_label("cohort").alias("cohort"),
            F.col("total_users"),
            F.col("k").cast("bigint").alias(offset_col),
            retention_pct("num_users", "total_users").alias("percentage"),
        )
    )


def _lit(ts: dt.datetime) -> str:
    return f"timestamp_ntz'{ts.isoformat(sep=' ')}'"
