"""Domain expressions, named once.

Numeric policy: money is counted in whole units of 1e-18 (wei for ETH) as DECIMAL(38,0) until the last projection, so
sums are exact and independent of partitioning (a DOUBLE sum changes with the order of partial aggregates), and no
amount is rounded. The last projection turns units into DOUBLE, whole part and remainder apart. Ratios divide
DECIMAL(38,0)-scaled operands, which Spark evaluates at scale 6 with HALF_UP rounding, like the warehouse's integer
division.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..timeframe import Timeframe, period_start

# Fixed values (categories and labels that appear in results).
ETH_TRANSFER = "ETH transfer"
EMPTY_CALL = "empty_call"
OTHER = "Other"
UNKNOWN = "Unknown"
NEWLY_ACTIVE = "Newly Active Deployer"
RETURNING = "Returning Deployer"
EXCLUDED_TOKEN_TYPE = "erc20"
LEADERBOARD_EXCLUDED_CATEGORIES = ("ERC20", "NFT")
PRICE_SYMBOL = "ETH"

UNITS_PER_ONE = Decimal(10) ** 18
# Token prices have nine places: a price times wei counts 1e-27, kept as units of 1e-18 and a remainder below 1e9.
PRICE_UNITS = Decimal(10) ** 9


def c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- fees --------------------------------------------------------------------------------------------------------

def l2_fee_wei() -> Column:
    """``receipt_effective_gas_price * receipt_gas_used`` in wei (exact decimal)."""
    return F.col("receipt_effective_gas_price") * F.col("receipt_gas_used")


def fee_wei() -> Column:
    """Total fee of a transaction in wei: L1 data fee plus L2 execution fee."""
    return F.col("receipt_l1_fee") + l2_fee_wei()


def whole(value: Decimal) -> Column:
    return F.lit(value).cast(f"decimal({len(str(int(value)))},0)")


def parts(units: Column | str, size: Decimal = UNITS_PER_ONE) -> tuple[Column, Column]:
    """(quotient, remainder) of whole units by ``size``, exact; the remainder has the sign of the units."""
    u = c(units).cast("decimal(38,0)")
    rest = u % whole(size)
    return ((u - rest) / whole(size)).cast("decimal(38,0)"), rest


def to_units(money: Column | str) -> Column:
    """An amount of at most 18 places (ETH, USD) in units of 1e-18; exact, as the product is whole."""
    return (c(money).cast("decimal(38,18)") * whole(UNITS_PER_ONE)).cast("decimal(38,0)")


def amount(units: Column | str, below: Column | str | None = None) -> Column:
    """Final projection of units of 1e-18 (and a remainder ``below`` in 1e-27) as DOUBLE, without rounding places."""
    quotient, rest = parts(units)
    rest = rest.cast("double")
    if below is not None:
        rest = rest + c(below).cast("double") / F.lit(1e9)
    return quotient.cast("double") + rest / F.lit(1e18)


def carried(high: Column | str, low: Column | str) -> tuple[Column, Column]:
    """Price x wei sums ``high * 1e9 + low`` (in 1e-27) as (units of 1e-18, remainder below 1e9)."""
    up, rest = parts(low, PRICE_UNITS)
    return (c(high).cast("decimal(38,0)") + up).cast("decimal(38,0)"), rest


# --- ratios and growth ---------------------------------------------------------------------------------------------

def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` at scale 6, HALF_UP; NULL when ``den`` is 0 or NULL."""
    return F.try_divide(c(num).cast("decimal(38,0)"), c(den).cast("decimal(38,0)"))


def share_pct(part: Column | str, total: Column | str) -> Column:
    """``100 * part / total`` at scale 6 as DOUBLE; NULL when the total is 0."""
    return ratio(c(part) * 100, total).cast("double")


def growth_card(current: Column | str, previous: Column | str) -> Column:
    """``round(100 * (current / nullif(previous, 0)) - 100, 1)``: NULL when there was no previous activity."""
    return F.round(ratio(current, F.nullif(c(previous), F.lit(0))) * 100 - 100, 1).cast("double")


def growth_pct(current: Column | str, previous: Column | str, otherwise: object = None) -> Column:
    """``100 * (current - previous) / previous`` when ``previous > 0``, else ``otherwise`` (NULL or 0)."""
    value = ratio((c(current) - c(previous)) * 100, previous).cast("double")
    fallback = F.lit(otherwise).cast("double")
    return F.when(c(previous) > 0, value).otherwise(fallback)


def retention_pct(users: Column | str, cohort_size: Column | str) -> Column:
    """``round(users * 100 / cohort_size, 2)`` (cohort size is at least 1)."""
    return F.round(ratio(c(users) * 100, cohort_size), 2).cast("double")


# --- classification ------------------------------------------------------------------------------------------------

def project_of(contract_address: Column | str, is_transfer: Column | str) -> Column:
    """Contract address if the target is a contract, else ``ETH transfer`` for value transfers (``value > 0``), else
    ``empty_call``."""
    return F.when(c(contract_address).isNotNull(), c(contract_address)).when(c(is_transfer), F.lit(ETH_TRANSFER)).otherwise(F.lit(EMPTY_CALL))


def key_deployment() -> Column:
    """Qualified deployment: not an erc20 token, minimum length and used. NULL token types drop out (SQL ``<>``)."""
    return (F.col("token_type") != EXCLUDED_TOKEN_TYPE) & (F.col("is_min_length") == 1) & (F.col("is_used") == 1)


# --- periods -------------------------------------------------------------------------------------------------------

def period(ts: Column | str, tf: Timeframe | str) -> Column:
    return period_start(ts, Timeframe.parse(tf))


def short_label(col: Column | str) -> Column:
    """Period label ``yy-MM-dd`` as shown by the charts."""
    return F.date_format(c(col), "yy-MM-dd")


def long_label(col: Column | str) -> Column:
    """Period label ``yyyy-MM-dd``."""
    return F.date_format(c(col), "yyyy-MM-dd")
