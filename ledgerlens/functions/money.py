"""Exact sums of wei without a big decimal per row.

Amounts that fit 64-bit parts (a price below 9e18 wei, gas below 9e8, a plain fee below 9e18 wei: all that a chain has in
practice) are summed as three long limbs, wei = high * 1e9 + mid * 1e4 + low, and put together once per group; the bounds
leave room for 9e13 rows a group and 9.2e9 ETH, beyond which the sum raises under ANSI arithmetic. Rows with larger amounts are
summed as decimals beside them. A row without a value counts as in a plain sum: not at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH, MID = 1_000_000_000, 10_000
PLAIN_BOUND, GAS_BOUND = 9 * 10**18, 9 * 10**8


class WeiSum:
    """The sum ``name`` of ``plain`` or ``price * gas`` or both added, in whole wei; use :meth:`columns`, :meth:`sums`, :meth:`total` in turn."""

    def __init__(self, name: str, plain: str | None = None, price: str | None = None, gas: str | None = None) -> None:
        self.name, self._plain, self._price, self._gas = name, plain, price, gas

    def _value(self) -> Column:
        parts = [F.col(self._plain)] if self._plain else []
        parts += [F.col(self._price) * F.col(self._gas)] if self._price else []
        return reduce(lambda a, b: a + b, parts).cast("decimal(38,0)")

    def _small(self) -> Column:
        bounds = [(self._plain, PLAIN_BOUND), (self._price, PLAIN_BOUND), (self._gas, GAS_BOUND)]
        return reduce(lambda a, b: a & b, [F.col(c) < F.lit(most).cast("decimal(20,0)") for c, most in bounds if c])

    def _limbs(self) -> tuple[Column, Column]:
        """(quotient, remainder of any size) of a small amount by ``HIGH``."""
        high, low = F.lit(0).cast("long"), F.lit(0).cast("long")
        if self._plain:
            p = F.col(self._plain).cast("long")
            high, low = high + _div(p, HIGH), low + p % HIGH
        if self._price:
            p, g = F.col(self._price).cast("long"), F.col(self._gas).cast("long")
            high, low = high + _div(p, HIGH) * g, low + (p % HIGH) * g
        return high + _div(low, HIGH), low % HIGH

    def columns(self, df: DataFrame) -> DataFrame:
        (high, low), small = self._limbs(), self._small()
        n = self.name
        return df.withColumns({
            f"_{n}_high": F.when(small, high), f"_{n}_mid": F.when(small, _div(low, MID)), f"_{n}_low": F.when(small, low % MID),
            f"_{n}_large": ~F.coalesce(small, F.lit(True)), f"_{n}_value": self._value(),
        })

    def sums(self) -> list[Column]:
        n = self.name
        return [*[F.sum(f"_{n}_{x}").alias(f"_{n}_{x}") for x in ("high", "mid", "low")], F.expr(f"sum(_{n}_value) FILTER (WHERE _{n}_large)").alias(f"_{n}_large")]

    def total(self) -> Column:
        """The sum from the summed columns; NULL if no row had a value."""
        n = self.name
        limb = lambda x, by: F.col(f"_{n}_{x}").cast("decimal(19,0)") * F.lit(by).cast("decimal(10,0)")
        small = (limb("high", HIGH) + limb("mid", MID) + F.col(f"_{n}_low")).cast("decimal(38,0)")
        large = F.col(f"_{n}_large").cast("decimal(38,0)")
        return F.coalesce((small + large).cast("decimal(38,0)"), small, large).alias(n)


def _div(a: Column, b: int) -> Column:
    """Whole quotient of longs that are not negative."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def sum_wei(df: DataFrame, by: list, *sums: WeiSum, more: tuple[Column, ...] = ()) -> DataFrame:
    """``by``, the totals of ``sums`` and the aggregates ``more`` per group (one row without ``by``)."""
    rows, names = df, [c if isinstance(c, str) else None for c in by]
    for s in sums:
        rows = s.columns(rows)
    grouped = rows.groupBy(*by).agg(*[x for s in sums for x in s.sums()], *more)
    inner = {f"_{s.name}_{x}" for s in sums for x in ("high", "mid", "low", "large")}
    keys = [c for c in grouped.columns if c not in inner][: len(names)]
    rest = [c for c in grouped.columns if c not in inner][len(names):]
    return grouped.select(*keys, *[s.total() for s in sums], *rest)


def fees(name: str = "rev_wei") -> WeiSum:
    """Total fee of transactions: the L1 data fee plus the L2 execution fee."""
    return WeiSum(name, plain="receipt_l1_fee", price="receipt_effective_gas_price", gas="receipt_gas_used")
