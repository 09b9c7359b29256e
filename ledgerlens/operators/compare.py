"""Two-period comparison: the last ``tf`` against the ``tf`` before it, per contract or per labelled app.

Windows: current = ``ts >= as_of - 1 tf`` (up to ``as_of``), previous = ``[as_of - 2 tf, as_of - 1 tf)``. Rows older
than ``as_of - 2 tf`` are filtered at the scan. Distinct transactions and wallets per window come from a two-level
aggregate (:func:`two_period_counts`) whose first shuffle is keyed by (group, value), so a contract with a third of
all rows is spread over all tasks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import LEADERBOARD_EXCLUDED_CATEGORIES, UNKNOWN, amount, fee_wei, growth_pct, period
from ..timeframe import Timeframe, ntz, shift, truncate


def two_period_counts(rows: DataFrame, keys: list, ts: str, as_of: dt.datetime, tf: Timeframe) -> DataFrame:
    """Per group ``keys``: distinct transactions and wallets in the current and previous window and the fee sums
    (exact wei) of both windows.

    Two-level plan: every row is tagged twice (wallet, hash) with its window flags; the first aggregate reduces to
    distinct (group, tag, value) with map-side combining and keyed by the value too, so a hot group spreads over all
    tasks; fees ride on the hash tag (each row belongs to exactly one hash group, NULL hashes included). The second
    aggregate counts flags per group. Catalyst's rewrite of four conditional ``count(distinct)`` would expand every
    row five times; this expands it twice and has a fixed plan shape.
    """
    one_ago, two_ago = shift(as_of, -1, tf), shift(as_of, -2, tf)
    cur = F.col(ts) >= ntz(one_ago)
    prev = (F.col(ts) < ntz(one_ago)) & (F.col(ts) >= ntz(two_ago))
    fee_type = rows.select(fee_wei().alias("fee")).schema["fee"].dataType
    pairs = F.array(
        F.struct(F.lit(0).alias("t"), F.col("from_address").cast("string").alias("v"), F.lit(None).cast(fee_type).alias("fee")),
        F.struct(F.lit(1).alias("t"), F.col("hash").cast("string").alias("v"), fee_wei().alias("fee")),
    )
    tagged = rows.filter(F.col(ts) >= ntz(two_ago)).select(
        *keys, cur.alias("_cur"), prev.alias("_prev"), F.explode(pairs).alias("_tv")
    ).select(*keys, "_cur", "_prev", F.col("_tv.fee").alias("_fee"), F.col("_tv.t").alias("_t"), F.col("_tv.v").alias("_v"))
    is_hash = F.col("_t") == 1
    level1 = tagged.groupBy(*keys, "_t", "_v").agg(
        F.bool_or("_cur").alias("_c"),
        F.bool_or("_prev").alias("_p"),
        F.sum(F.when(F.col("_cur"), F.col("_fee"))).alias("_fc"),
        F.sum(F.when(F.col("_prev"), F.col("_fee"))).alias("_fp"),
    )
    counted = F.col("_v").isNotNull()
    return level1.groupBy(*keys).agg(
        F.count_if(is_hash & F.col("_c") & counted).alias("txns_current"),
        F.count_if(is_hash & F.col("_p") & counted).alias("txns_previous"),
        F.count_if(~is_hash & F.col("_c") & counted).alias("active_accounts_current"),
        F.count_if(~is_hash & F.col("_p") & counted).alias("active_accounts_previous"),
        F.sum("_fc").alias("gas_wei_current"),
        F.sum("_fp").alias("gas_wei_previous"),
    )


def target_activity(tx: DataFrame, more: tuple[Column, ...] = ()) -> DataFrame:
    """Transactions per (day, target, sender): ``day, to_address, from_address, transactions`` (distinct hashes) ``, fee_wei`` and ``more``. A
    transaction has one time, target and sender, so its rows, repeated ones too, meet in one row here and counts add up."""
    return tx.groupBy(period("block_timestamp", Timeframe.DAY).alias("day"), "to_address", "from_address").agg(
        F.count_distinct("hash").alias("transactions"), F.sum(fee_wei()).alias("fee_wei"), *more)


def window_parts(as_of: dt.datetime, tf: Timeframe) -> tuple[list[tuple[dt.datetime, dt.datetime]], list[tuple[dt.datetime, dt.datetime]]]:
    """The two windows as whole days, ``[(first, end) of the current and of the previous one]``, and the days that a window's end
    divides, as (start, end)."""
    one_ago, two_ago, day = shift(as_of, -1, tf), shift(as_of, -2, tf), dt.timedelta(days=1)

    def after(ts: dt.datetime) -> dt.datetime:
        start = truncate(ts, Timeframe.DAY)
        return start if start == ts else start + day

    whole = [(after(one_ago), truncate(as_of, Timeframe.DAY)), (after(two_ago), truncate(one_ago, Timeframe.DAY))]
    # The open day is always read: ``as_of`` itself belongs to the current window.
    cut = {truncate(ts, Timeframe.DAY) for ts in (one_ago, two_ago) if after(ts) != ts} | {truncate(as_of, Timeframe.DAY)}
    return whole, [(start, start + day) for start in sorted(cut)]


def two_period_pairs(stored: DataFrame, edges: DataFrame, as_of: dt.datetime, tf: Timeframe) -> DataFrame:
    """One row per (target, sender) with transactions and fees of both windows: whole days from the stored
    :func:`target_activity`, ``edges`` (transactions of the divided days) to the time of day."""
    whole, _ = window_parts(as_of, tf)
    one_ago, two_ago = shift(as_of, -1, tf), shift(as_of, -2, tf)
    in_days = [(F.col("day") >= ntz(a)) & (F.col("day") < ntz(b)) for a, b in whole]
    from_days = stored.filter(in_days[0] | in_days[1]).select("to_address", "from_address", in_days[0].alias("_cur"), "transactions", "fee_wei")
    ts = F.col("block_timestamp")
    # Each divided day on its own: a part of a day that is whole for a window is in the stored rows.
    inside = edges.filter((ts >= ntz(two_ago)) & (ts <= ntz(as_of)))
    cut = inside.groupBy("to_address", "from_address", (ts >= ntz(one_ago)).alias("_cur")).agg(F.count_distinct("hash").alias("transactions"), F.sum(fee_wei()).alias("fee_wei"))
    both = from_days.unionByName(cut.withColumn("fee_wei", F.col("fee_wei").cast("decimal(38,0)")))
    cur = F.col("_cur")
    return both.groupBy("to_address", "from_address").agg(
        F.bool_or(cur).alias("_c"), F.bool_or(~cur).alias("_p"), F.sum(F.when(cur, F.col("transactions"))).alias("_tc"), F.sum(F.when(~cur, F.col("transactions"))).alias("_tp"),
        F.sum(F.when(cur, F.col("fee_wei"))).alias("_fc"), F.sum(F.when(~cur, F.col("fee_wei"))).alias("_fp"),
    )


def two_period_from_pairs(pairs: DataFrame, keys: list) -> DataFrame:
    """:func:`two_period_counts` from rows of :func:`two_period_pairs` with ``keys``: a sender counts once per group."""
    per_sender = pairs.groupBy(*keys, "from_address").agg(F.bool_or("_c").alias("_c"), F.bool_or("_p").alias("_p"), *[F.sum(x).alias(x) for x in ("_tc", "_tp", "_fc", "_fp")])
    known = F.col("from_address").isNotNull()
    return per_sender.groupBy(*keys).agg(
        F.coalesce(F.sum("_tc"), F.lit(0)).alias("txns_current"), F.coalesce(F.sum("_tp"), F.lit(0)).alias("txns_previous"),
        F.count_if(known & F.col("_c")).alias("active_accounts_current"), F.count_if(known & F.col("_p")).alias("active_accounts_previous"),
        F.sum("_fc").alias("gas_wei_current"), F.sum("_fp").alias("gas_wei_previous"),
    )


def trending(tx: DataFrame, contracts: DataFrame, labels: DataFrame, as_of: dt.datetime, tf: Timeframe | str, min_wallets: int = 10, limit: int = 20) -> DataFrame:
    """Trending contracts: previous wallets above ``min_wallets`` and growing; top ``limit`` by current
    transactions (ties by contract). Growth is NULL when the previous value is not positive.

    The contract test is applied after aggregation: one row per target address meets ``contracts`` in a semi join,
    instead of every transaction meeting it. This equals the inner join because contract addresses are unique.
    """
    tf = Timeframe.parse(tf)
    per_target = two_period_counts(tx.withColumnRenamed("to_address", "contract"), ["contract"], "block_timestamp", as_of, tf)
    return rank_trending(per_target, contracts, labels, min_wallets, limit)


def rank_trending(per_target: DataFrame, contracts: DataFrame, labels: DataFrame, min_wallets: int, limit: int) -> DataFrame:
    """The trending table from both windows' counts per ``contract``."""
    is_contract = contracts.select(F.col("address").alias("contract"))
    ranked = per_target.join(is_contract, "contract", "left_semi").filter(
        (F.col("active_accounts_previous") > min_wallets) & ((F.col("active_accounts_current") - F.col("active_accounts_previous")) > 0)
    )
    names = labels.select(F.col("address").alias("contract"), F.col("name").alias("_name"))
    out = ranked.join(names, "contract", "left").select(
        "contract",
        F.coalesce("_name", F.lit(UNKNOWN)).alias("project"),
        amount("gas_wei_current").alias("gas_spend_current"),
        growth_pct("gas_wei_current", "gas_wei_previous").alias("gas_growth"),
        F.col("txns_current"),
        growth_pct("txns_current", "txns_previous").alias("txn_growth"),
        F.col("active_accounts_current"),
        growth_pct("active_accounts_current", "active_accounts_previous").alias("accounts_growth"),
    )
    return out.orderBy(F.col("txns_current").desc(), F.col("contract").asc()).limit(limit)


def leaderboard(tx: DataFrame, labels: DataFrame, as_of: dt.datetime, tf: Timeframe | str) -> DataFrame:
    """Per labelled app (name, slug, category), excluding ERC20 and NFT categories: current fees, transactions and
    wallets with growth over the previous period (0 when there was none). Ordered by fees, NULLs last.

    Distinct wallets of an app cannot be merged from per-address counts, so transactions are mapped to apps first:
    a join with the label table, which Spark broadcasts when its size check allows (no shuffle of the transactions
    on a hot address); beyond the threshold AQE splits skewed partitions of the sort-merge join.
    """
    tf = Timeframe.parse(tf)
    two_ago = shift(as_of, -2, tf)
    rows = tx.filter(F.col("block_timestamp") >= ntz(two_ago)).join(ranked_apps(labels), F.col("to_address") == F.col("_address"))
    return rank_apps(two_period_counts(rows, APP, "block_timestamp", as_of, tf))


#: What makes an app: addresses that share all three are one.
APP = ["project", "slug", "category"]


def ranked_apps(labels: DataFrame) -> DataFrame:
    """The labelled addresses of the leaderboard: ``_address`` and the app's columns."""
    excluded = [F.col("category") != cat for cat in LEADERBOARD_EXCLUDED_CATEGORIES]
    return labels.filter(excluded[0] & excluded[1]).select(F.col("address").alias("_address"), F.col("name").alias("project"), "slug", "category")


def rank_apps(agg: DataFrame) -> DataFrame:
    """The leaderboard from both windows' counts per app."""
    return agg.orderBy(F.col("gas_wei_current").desc_nulls_last(), "project", "slug", "category").select(
        "project",
        "slug",
        "category",
        amount("gas_wei_current").alias("eth_fees"),
        growth_pct("gas_wei_current", "gas_wei_previous", 0).alias("eth_fees_growth"),
        F.col("txns_current").alias("transactions"),
        growth_pct("txns_current", "txns_previous", 0).alias("transactions_growth"),
        F.col("active_accounts_current").alias("wallets"),
        growth_pct("active_accounts_current", "active_accounts_previous", 0).alias("wallets_growth"),
    )
