"""Daily economic report: seven daily series star-joined on the revenue days.

Each series is a per-day aggregate over ``[start, end]``, where ``end`` is midnight at the start of the end date,
so that date only holds rows stamped exactly 00:00:00. Revenue and transaction count share one scan and one
aggregate. The joined sides have at most one row per day of the range, a bound known from the parameters, so they
are broadcast.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import amount, long_label, period, to_units
from ..functions.joins import bounded
from ..functions.money import fees, sum_wei
from ..sources.registry import Tables
from ..timeframe import Timeframe, as_datetime, ntz
from .periods import PERIOD, period_agg

# Cost and revenue series of the report and their source columns.
SERIES = (
    ("l1_messaging_rev", "l1_bridge_revenue", "bridge_fee"),
    ("l1_batch_posting_cost", "l1_batch_fees", "gas_spend"),
    ("l1_batch_verification_cost", "l1_verification_fees", "gas_spend"),
    ("l1_gas_oracle_cost", "l1_gas_oracle_fees", "gas_spend"),
    ("l2_gas_oracle_cost", "l2_gas_oracle_fees", "gas_spend"),
)


def daily_report(tables: Tables, start: dt.date | str, end: dt.date | str) -> DataFrame:
    lo, hi = as_datetime(start), as_datetime(end)
    day = Timeframe.DAY
    tx = tables["transactions"].filter(F.col("receipt_effective_gas_price") > 0)
    inside = tx.filter((F.col("block_timestamp") >= ntz(lo)) & (F.col("block_timestamp") <= ntz(hi)))
    l2 = sum_wei(inside, [period("block_timestamp", day).alias(PERIOD)], fees(), more=(F.count(F.lit(1)).alias("l2_transaction_quantity"),))
    joined = l2
    for name, table, col in SERIES:
        # At most one row per day in [start, end].
        series = period_agg(tables[table], "block_timestamp", day, [F.sum(F.col(col).cast("decimal(38,18)")).alias(name)], since=lo, until=hi).select(PERIOD, to_units(name).alias(name))
        joined = joined.join(bounded(series), PERIOD, "left")
    l1_oracle = F.coalesce("l1_gas_oracle_cost", F.lit(0))
    l2_oracle = F.coalesce("l2_gas_oracle_cost", F.lit(0))
    eth = F.col("rev_wei")
    return joined.orderBy(PERIOD).select(
        long_label(PERIOD).alias("day"),
        amount(eth).alias("l2_gas_rev"),
        amount("l1_messaging_rev").alias("l1_messaging_rev"),
        amount("l1_batch_posting_cost").alias("l1_batch_posting_cost"),
        amount("l1_batch_verification_cost").alias("l1_batch_verification_cost"),
        amount(l1_oracle).alias("l1_gas_oracle_cost"),
        amount(l2_oracle).alias("l2_gas_oracle_cost"),
        amount(eth + F.col("l1_messaging_rev")).alias("total_revenue"),
        amount(F.col("l1_batch_posting_cost") + F.col("l1_batch_verification_cost") + l1_oracle + l2_oracle).alias("total_cost"),
        F.col("l2_transaction_quantity"),
    )
