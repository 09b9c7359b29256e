"""Fee revenue valued at the hourly token price.

The price of a symbol is constant within an hour, so ``sum(price * fee)`` over the rows of an hour equals
``price * sum(fee)``. Transactions are therefore aggregated to one row per hour *before* the price join (partial
aggregation map-side); the join then meets two calendar-bounded inputs (hours of history) instead of every
transaction. Hours without a price drop out (inner join), as do rows with a zero gas price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import PRICE_SYMBOL, PRICE_UNITS, parts, whole
from ..functions.money import fees, sum_wei
from ..timeframe import period_start


def hourly_revenue(tx: DataFrame) -> DataFrame:
    """Fee revenue per hour, zero-gas-price rows excluded: ``hour, rev_wei``."""
    return sum_wei(tx.filter(F.col("receipt_effective_gas_price") > 0), [period_start("block_timestamp", "hour").alias("hour")], fees())


def priced_hours(tx: DataFrame, prices: DataFrame, symbol: str = PRICE_SYMBOL) -> DataFrame:
    """One row per priced hour: ``hour, rev_wei`` and the exact price x wei as ``usd_high * 1e9 + usd_low`` in 1e-27 USD."""
    return value_hours(hourly_revenue(tx), prices, symbol)


def value_hours(hourly: DataFrame, prices: DataFrame, symbol: str = PRICE_SYMBOL) -> DataFrame:
    """Value an hourly ``hour, rev_wei`` series at the hour's price; hours without a price drop out."""
    # ``(hour, symbol)`` is unique: one row per hour of history. The planner broadcasts it when it is under the
    # broadcast threshold; either way it meets the hourly aggregate, not the transactions.
    px = prices.filter(F.col("symbol") == symbol).select("hour", "usd_price")
    # The price in whole 1e-9 times the wei in two limbs: neither product can pass 38 digits or lose a place.
    price = (F.col("usd_price") * whole(PRICE_UNITS)).cast("decimal(20,0)")
    high, low = parts("rev_wei", PRICE_UNITS)
    usd = [(price * limb.cast(kind)).cast("decimal(38,0)").alias(name) for limb, kind, name in ((high, "decimal(29,0)", "usd_high"), (low, "decimal(10,0)", "usd_low"))]
    return hourly.join(px, "hour").select("hour", "rev_wei", *usd)
