"""Economics: fee revenue (ETH and USD), batch and verification costs, profit, and the L1/L2 fee split.

Unlike the user charts, these period charts include the current, partial period.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import amount, carried, l2_fee_wei, share_pct, to_units
from ..functions.joins import bounded
from ..functions.money import WeiSum, fees, sum_wei
from ..operators.periods import PERIOD, labelled, period_agg
from ..operators.prices import priced_hours, value_hours
from ..sources.registry import Tables
from ..timeframe import Timeframe, as_datetime, ntz, period_start, shift

TX = "transactions"
L1_WEI = WeiSum("l1_wei", plain="receipt_l1_fee")
L2_WEI = WeiSum("l2_wei", price="receipt_effective_gas_price", gas="receipt_gas_used")
# Trailing windows of the scalar cards (None = all time).
SCALAR_WINDOWS = {"week": (1, Timeframe.WEEK), "month": (1, Timeframe.MONTH), "all": None}


def _costs(tables: Tables, table: str, tf: Timeframe, name: str) -> DataFrame:
    # Amounts of 18 places add up exactly as they are; only the totals turn into units.
    sums = [F.sum(F.col(x).cast("decimal(38,18)")).alias(x) for x in ("gas_spend", "gas_spend_usd")]
    per = period_agg(tables[table], "block_timestamp", tf, sums)
    return per.select(PERIOD, to_units("gas_spend").alias(name), to_units("gas_spend_usd").alias(f"{name}_usd"))


def hourly_fees(tables: Tables, as_of, more: tuple[Column, ...] = ()) -> DataFrame:
    """Rollup of transactions to at most two rows per hour: ``hour, priced_gas`` (gas price > 0), ``rev_wei``,
    ``l1_wei``, ``l2_wei``, ``transactions`` and the aggregates ``more``. Fees are additive, so every hour-aligned economics series can read it
    instead of the transactions."""
    tx = tables.as_of(as_datetime(as_of))[TX]
    by = [period_start("block_timestamp", "hour").alias("hour"), (F.col("receipt_effective_gas_price") > 0).alias("priced_gas")]
    return sum_wei(tx, by, fees(), L1_WEI, L2_WEI, more=(F.count(F.lit(1)).alias("transactions"), *more))


def _revenue(tables: Tables, tf: Timeframe, hourly: DataFrame | None = None) -> DataFrame:
    """Per period: ``rev_wei``, and the USD value as ``usd_units`` (1e-18) and ``usd_rest`` (1e-27) of priced hours."""
    if hourly is not None:
        hours = value_hours(hourly.filter(F.col("priced_gas")).select("hour", "rev_wei"), tables["token_prices_hourly"])
    else:
        hours = priced_hours(tables[TX], tables["token_prices_hourly"])
    sums = [F.sum(x).alias(x) for x in ("rev_wei", "usd_high", "usd_low")]
    per = hours.groupBy(F.date_trunc(tf.value, "hour").cast("timestamp_ntz").alias(PERIOD)).agg(*sums)
    units, rest = carried("usd_high", "usd_low")
    return per.select(PERIOD, "rev_wei", units.alias("usd_units"), rest.alias("usd_rest"))


def batch_fees(tables: Tables, as_of, tf: Timeframe | str) -> DataFrame:
    """Batch posting cost per period: ``date, batch_fees, batch_fees_usd``."""
    tf = Timeframe.parse(tf)
    agg = _costs(tables.as_of(as_datetime(as_of)), "l1_batch_fees", tf, "batch_fees")
    return labelled(agg.select(PERIOD, amount("batch_fees").alias("batch_fees"), amount("batch_fees_usd").alias("batch_fees_usd")))


def verify_fees(tables: Tables, as_of, tf: Timeframe | str) -> DataFrame:
    """Verification cost per period: ``date, verification_fees, verification_fees_usd``."""
    tf = Timeframe.parse(tf)
    agg = _costs(tables.as_of(as_datetime(as_of)), "l1_verification_fees", tf, "verification_fees")
    return labelled(
        agg.select(PERIOD, amount("verification_fees").alias("verification_fees"), amount("verification_fees_usd").alias("verification_fees_usd"))
    )


def gas_revenue(tables: Tables, as_of, tf: Timeframe | str, hourly: DataFrame | None = None) -> DataFrame:
    """Fee revenue per period at the hourly ETH price: ``date, gas_rev, gas_rev_usd``. Hours without a price and
    zero-gas-price rows are left out."""
    tf = Timeframe.parse(tf)
    rev = _revenue(tables.as_of(as_datetime(as_of)), tf, hourly)
    return labelled(rev.select(PERIOD, amount("rev_wei").alias("gas_rev"), amount("usd_units", "usd_rest").alias("gas_rev_usd")))


def gross_profit(tables: Tables, as_of, tf: Timeframe | str, hourly: DataFrame | None = None) -> DataFrame:
    """Revenue minus batch and verification cost per period: ``date, profit, profit_usd``.

    Kept quirk: the verification cost is joined on the *batch* period, so a period without a batch row keeps its
    verification cost out of the profit.
    """
    tf = Timeframe.parse(tf)
    t = tables.as_of(as_datetime(as_of))
    rev = _revenue(t, tf, hourly)
    # One row per period each.
    batch = bounded(_costs(t, "l1_batch_fees", tf, "bf").withColumnRenamed(PERIOD, "_bp"))
    verify = bounded(_costs(t, "l1_verification_fees", tf, "vf").withColumnRenamed(PERIOD, "_vp"))
    j = rev.join(batch, rev[PERIOD] == batch["_bp"], "left").join(verify, F.col("_bp") == verify["_vp"], "left")
    profit = F.col("rev_wei") - F.coalesce("bf", F.lit(0)) - F.coalesce("vf", F.lit(0))
    profit_usd = F.col("usd_units") - F.coalesce("bf_usd", F.lit(0)) - F.coalesce("vf_usd", F.lit(0))
    return labelled(j.select(PERIOD, amount(profit).alias("profit"), amount(profit_usd, "usd_rest").alias("profit_usd")))


def _since(df: DataFrame, as_of: dt.datetime, window) -> DataFrame:
    if window is None:
        return df
    n, unit = window
    return df.filter(F.col("block_timestamp") >= ntz(shift(as_of, -n, unit)))


def _windowed(tables: Tables, as_of: dt.datetime, window) -> Tables:
    t = tables.as_of(as_of)
    return t.window(shift(as_of, -window[0], window[1])) if window else t


def _revenue_total(t: Tables, as_of: dt.datetime, window, hourly: DataFrame | None) -> DataFrame:
    """One row, ``rev_wei``, of the window: from the transactions, or from the hourly rollup and the transactions of the partial hour at the
    window's start."""
    if hourly is None:
        return sum_wei(_since(t[TX], as_of, window).filter(F.col("receipt_effective_gas_price") > 0), [], fees())
    priced = hourly.filter(F.col("priced_gas"))
    if window is None:
        return priced.agg(F.sum("rev_wei").alias("rev_wei"))
    start = shift(as_of, -window[0], window[1])
    hour = start.replace(minute=0, second=0, microsecond=0)
    if hour == start:
        return priced.filter(F.col("hour") >= ntz(hour)).agg(F.sum("rev_wei").alias("rev_wei"))
    whole = hour + dt.timedelta(hours=1)
    first = t.window(start, whole, names=(TX,))[TX].filter((F.col("block_timestamp") >= ntz(start)) & (F.col("block_timestamp") < ntz(whole)))
    rest = sum_wei(first.filter(F.col("receipt_effective_gas_price") > 0), [], fees())
    hours = priced.filter(F.col("hour") >= ntz(whole)).agg(F.sum("rev_wei").cast("decimal(38,0)").alias("rev_wei"))
    return hours.unionByName(rest).agg(F.sum("rev_wei").alias("rev_wei"))


def scalar_revenue(tables: Tables, as_of, window: str, hourly: DataFrame | None = None) -> DataFrame:
    """Fee revenue (ETH, zero gas price excluded, no price needed) over ``week``, ``month`` or ``all``: ``gas_rev``.
    With ``hourly`` (the rollup) a trailing window reads transactions of its first, partial hour only."""
    as_of = as_datetime(as_of)
    win = SCALAR_WINDOWS[window]
    return _revenue_total(_windowed(tables, as_of, win), as_of, win, hourly).select(amount("rev_wei").alias("gas_rev"))


def scalar_profit(tables: Tables, as_of, window: str, hourly: DataFrame | None = None) -> DataFrame:
    """Revenue minus batch and verification cost over ``week``, ``month`` or ``all``: ``profit``. NULL without
    revenue; missing costs count as 0."""
    as_of = as_datetime(as_of)
    win = SCALAR_WINDOWS[window]
    t = _windowed(tables, as_of, win)
    value = "decimal(38,0)"

    def cost(table: str) -> DataFrame:
        return _since(t[table], as_of, win).agg(F.sum(F.col("gas_spend").cast("decimal(38,18)")).alias("v")).select(F.lit("cost").alias("k"), to_units("v").cast(value).alias("v"))

    # Three totals of one row each, tagged and put together without a join.
    rev = _revenue_total(t, as_of, win, hourly).select(F.lit("rev").alias("k"), F.col("rev_wei").cast(value).alias("v"))
    totals = rev.unionByName(cost("l1_batch_fees")).unionByName(cost("l1_verification_fees"))
    total = totals.agg(*[F.sum(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("rev", "cost")])
    return total.select(amount(F.col("rev") - F.coalesce("cost", F.lit(0))).alias("profit"))


def l1vl2fee(tables: Tables, as_of, tf: Timeframe | str, hourly: DataFrame | None = None) -> DataFrame:
    """Share (%) of the L1 data fee and of the L2 execution fee in the total fee per period: ``date, l1_fee, l2_fee``. The total
    leaves out rows that lack one of the two fees."""
    tf = Timeframe.parse(tf)
    if hourly is not None:
        sums = [F.sum("l1_wei").alias("l1_wei"), F.sum("l2_wei").alias("l2_wei"), F.sum("rev_wei").alias("total")]
        agg = period_agg(hourly, "hour", tf, sums)
    else:
        t = tables.as_of(as_datetime(as_of))
        by = [period_start("block_timestamp", tf).alias(PERIOD)]
        half = F.col("receipt_l1_fee").isNull() != l2_fee_wei().isNull()
        rows = t[TX].withColumns({"_half": half, "_lone": F.when(half, F.coalesce(F.col("receipt_l1_fee").cast("decimal(38,0)"), l2_fee_wei().cast("decimal(38,0)")))})
        agg = sum_wei(rows, by, L1_WEI, L2_WEI, more=(F.expr("sum(_lone) FILTER (WHERE _half)").alias("_lone"),))
        agg = agg.withColumn("total", F.col("l1_wei") + F.col("l2_wei") - F.coalesce("_lone", F.lit(0)))
    return labelled(agg.select(PERIOD, share_pct("l1_wei", "total").alias("l1_fee"), share_pct("l2_wei", "total").alias("l2_fee")))


def dashboard(tables: Tables, as_of, timeframe: Timeframe | str = Timeframe.MONTH, hourly: DataFrame | None = None) -> dict[str, DataFrame]:
    """All economics metrics of one request; plans only, no job runs here. With ``hourly``, a stored fee rollup (see
    :mod:`.rollups`), the period charts and the all-time cards read it instead of the transaction history."""
    as_of, tf = as_datetime(as_of), Timeframe.parse(timeframe)
    out = {
        "gross_profit": gross_profit(tables, as_of, tf, hourly),
        "batch_fees": batch_fees(tables, as_of, tf),
        "verify_fees": verify_fees(tables, as_of, tf),
        "gas_revenue": gas_revenue(tables, as_of, tf, hourly),
        "l1vl2fee": l1vl2fee(tables, as_of, tf, hourly),
    }
    for window in SCALAR_WINDOWS:
        out[f"{window}_gross_profit"] = scalar_profit(tables, as_of, window, hourly)
        out[f"{window}_revenue"] = scalar_revenue(tables, as_of, window, hourly)
    return out


__all__ = ["batch_fees", "verify_fees", "gas_revenue", "gross_profit", "scalar_revenue", "scalar_profit", "l1vl2fee", "dashboard"]
