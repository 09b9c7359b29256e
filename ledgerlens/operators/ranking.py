"""Per-period top-k with the rest folded into ``Other``.

Semantics: projects are ranked per period over *all* projects; then projects with at most ``min_wallets`` wallets
are dropped (so fewer than ``k`` projects may be named); kept projects ranked ``<= k`` are named, the other kept
projects are summed into ``Other``. Ties in the ranking measure are broken by project, ascending.

Plan, built so that no period's project list is ever sorted in one task:

* ``named``: ``row_number() <= k`` over the aggregated (period, project) rows. Catalyst turns the rank filter into a
  partial ``WindowGroupLimit`` before the shuffle, so each task sends at most ``k`` rows per period.
* ``Other``: the sum over all kept projects minus the named projects' part, per period, computed by one partial
  aggregate over a union (one row per period and task leaves the map side). Measures are exact (integers, decimal
  wei), so the subtraction is exact.

Both branches read the same aggregate and Spark reuses its shuffle output (``ReusedExchange``). For that the
aggregate must canonicalize identically in both branches, which Catalyst's multi-``count(distinct)`` rewrite does
not guarantee (its ``Expand`` order follows attribute ids); two distinct counts therefore use
:func:`~ledgerlens.functions.aggs.distinct_counts`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import OTHER, amount, fee_wei, long_label, period, project_of
from ..functions.aggs import distinct_counts
from ..functions.joins import bounded, fits_broadcast
from ..timeframe import Timeframe
from .periods import PERIOD


def top_k_other(agg: DataFrame, measure: str, rank_by: str, wallets: str, k: int = 10, min_wallets: int = 10, by: tuple[str, ...] = (PERIOD,)) -> DataFrame:
    """``agg`` has one row per (``_period``, ``project``), or per ``by`` and project. Returns ``_period, project, {measure}`` with at most
    ``k`` named projects and one ``Other`` row per period (when kept projects remain after the named ones)."""
    order = [F.col(rank_by).desc_nulls_first(), F.col("project").asc()]
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    named = agg.withColumn("_rn", rn).filter((F.col("_rn") <= k) & (F.col(wallets) > min_wallets))
    kept = agg.filter(F.col(wallets) > min_wallets)
    # Other = (all kept projects) - (named projects), per period, in one aggregate over a union (no join): a named row
    # enters twice, as itself and negated under ``Other``; the ranking runs once.
    row = lambda project, m, n: F.struct(project.alias("project"), m.alias("_m"), F.lit(n).alias("_n"))
    m = F.col(measure)
    twice = named.select(*by, F.inline(F.array(row(F.col("project"), m, 1), row(F.lit(OTHER), (-m).cast(agg.schema[measure].dataType), -1))))
    union = twice.unionByName(kept.select(*by, F.lit(OTHER).alias("project"), m.alias("_m"), F.lit(1).alias("_n")))
    folded = union.groupBy(*by, "project").agg(F.sum("_m").alias(measure), F.sum("_n").alias("_n"))
    return folded.filter(F.col("_n") > 0).drop("_n")


#: The column by which the bucketed layout of transactions is dealt.
STORED_KEY = "target_key"
#: Most frequent targets that are resolved by a broadcast: a bound by construction.
HOT_TARGETS = 10_000


def _classified_rows(rows: DataFrame, contracts: DataFrame) -> DataFrame:
    """:func:`_classified` for rows that cannot be reduced before the join: a broadcast join where Spark estimates the contracts
    below its threshold, else :func:`_classified_spread`. Results are the same."""
    return _classified(rows, contracts) if fits_broadcast(contracts.select("address")) else _classified_spread(rows, contracts)


def _classified_spread(rows: DataFrame, contracts: DataFrame) -> DataFrame:
    """:func:`_classified` without shuffling rows on a hot address.

    The ``HOT_TARGETS`` most frequent targets (counted with map-side combining) meet the contracts first and are broadcast.
    Rows of these, and rows without a target, are settled by that and stay where they are; only the other rows are
    shuffled, by an address that is not hot. Both parts read ``rows``, or the shuffle that made them.
    """
    some = rows.filter(F.col("to_address").isNotNull() | F.col("_transfer"))
    counts = some.filter(F.col("to_address").isNotNull()).groupBy("to_address").agg(F.count(F.lit(1)).alias("_rows"))
    top = counts.orderBy(F.col("_rows").desc(), "to_address").limit(HOT_TARGETS).select(F.col("to_address").alias("_hot"))
    targets = contracts.select(F.col("address").alias("_contract"))
    hot = top.join(targets, F.col("_hot") == F.col("_contract"), "left").select("_hot", F.col("_contract").isNotNull().alias("_hot_known"))
    resolved = some.join(bounded(hot), F.col("to_address") == F.col("_hot"), "left")
    settled = F.col("_hot").isNotNull() | F.col("to_address").isNull()
    known = resolved.filter(settled).withColumn("_is_contract", F.coalesce("_hot_known", F.lit(False))).drop("_hot", "_hot_known")
    cold = resolved.filter(~settled).drop("_hot", "_hot_known").join(targets, F.col("to_address") == F.col("_contract"), "left")
    both = known.unionByName(cold.withColumn("_is_contract", F.col("_contract").isNotNull()).drop("_contract"))
    kept = both.filter(F.col("_is_contract") | F.col("_transfer"))
    return kept.withColumn("project", project_of(F.when(F.col("_is_contract"), F.col("to_address")), "_transfer"))


def _classified(rows: DataFrame, contracts: DataFrame) -> DataFrame:
    """Attach ``project`` to rows keyed by target address and value flag: the address when the target is a
    contract, ``ETH transfer`` for value transfers to other addresses; zero-value calls to non-contracts drop out."""
    targets = contracts.select(F.col("address").alias("_contract"))
    joined = rows.join(targets, rows["to_address"] == targets["_contract"], "left")
    kept = joined.filter(F.col("_contract").isNotNull() | F.col("_transfer"))
    return kept.withColumn("project", project_of("_contract", "_transfer"))


def _classified_stored(rows: DataFrame, contracts: DataFrame, hot: DataFrame) -> DataFrame:
    """:func:`_classified` for rows of the bucketed layout (see ``sources/bucketed.py``): the join on its key needs no shuffle where
    contracts are bucketed alike, and hot targets, one row each, are looked up apart. A contract's address is matched by
    one of the two, never by both: a row's key is its target or no address."""
    targets = contracts.select(F.col("address").alias("_contract"))
    is_hot = targets.join(bounded(hot.select(F.col("address").alias("_hot"))), F.col("_hot") == F.col("_contract")).select("_hot")
    some = rows.filter(F.col("to_address").isNotNull() | F.col("_transfer"))
    joined = some.join(targets, F.col(STORED_KEY) == F.col("_contract"), "left").join(bounded(is_hot), F.col("to_address") == F.col("_hot"), "left")
    is_contract = F.col("_contract").isNotNull() | F.col("_hot").isNotNull()
    return joined.filter(is_contract | F.col("_transfer")).withColumn("project", project_of(F.when(is_contract, F.col("to_address")), "_transfer"))


def project_chart(tx: DataFrame, contracts: DataFrame, labels: DataFrame, tf: Timeframe | str, measure: str, k: int = 10, min_wallets: int = 10) -> DataFrame:
    """Project chart for ``measure`` in ``num_transactions`` (ranked by wallets), ``eth_fees`` (ranked by fees) or
    ``num_unique_wallets`` (ranked by wallets). Output: ``date (yyyy-MM-dd), project, {measure}``.

    The project of a row depends only on its target address and on ``value > 0``. For the wallet and fee measures
    rows are first reduced to distinct (period, target, flag, wallet) with map-side aggregation (fees pre-summed),
    and only those rows meet the contract table: a wallet calling the same contract many times in a period crosses
    the join once. Transaction counts need every hash, so there the rows meet the contract table as they are.
    """
    tf = Timeframe.parse(tf)
    target = [PERIOD, "to_address", "_transfer"]
    base = tx.select(
        period("block_timestamp", tf).alias(PERIOD), "to_address", (F.col("value") > 0).alias("_transfer"), "from_address", "hash", fee_wei().alias("fee")
    )
    if measure == "num_transactions":
        # Transaction hashes are (nearly) unique, so no reduction would happen before the join: rows meet the
        # contract table as they are, then both distinct counts run in one fixed-shape two-level aggregate.
        rows = _classified_rows(base.drop("fee"), contracts)
        agg = distinct_counts(rows, [PERIOD, "project"], {"num_unique_wallets": "from_address", "num_transactions": "hash"})
    elif measure == "eth_fees":
        per_target = base.groupBy(*target, "from_address").agg(F.sum("fee").alias("fee"))
        agg = _classified(per_target, contracts).groupBy(PERIOD, "project").agg(
            F.count_distinct("from_address").alias("num_unique_wallets"), F.sum("fee").alias("fee_wei")
        )
    elif measure == "num_unique_wallets":
        per_target = base.select(*target, "from_address").distinct()
        agg = _classified(per_target, contracts).groupBy(PERIOD, "project").agg(F.count_distinct("from_address").alias("num_unique_wallets"))
    else:
        raise ValueError(f"unknown measure {measure!r}")
    return ranked_chart(agg, labels, measure, k, min_wallets)


#: Measures of the project charts: column of the aggregate, and the one that ranks.
MEASURES = {"num_transactions": ("num_transactions", "num_unique_wallets"), "eth_fees": ("fee_wei", "fee_wei"), "num_unique_wallets": ("num_unique_wallets", "num_unique_wallets")}


def project_aggregate(tx: DataFrame, contracts: DataFrame, tf: Timeframe | str, hot: DataFrame | None = None) -> DataFrame:
    """One row per (``_period``, ``project``) with all measures, from one scan and one contract join: ``num_unique_wallets``,
    ``num_transactions``, ``fee_wei``. With ``hot``, the hot targets of the bucketed layout, that join shuffles neither side.

    Each row is tagged twice, as its wallet and as its hash with the fee, and reduced to distinct (group, tag, value) with map-side
    combining before it is counted, so a project with a third of all rows spreads over all tasks.
    """
    base = tx.select(period("block_timestamp", tf).alias(PERIOD), "to_address", (F.col("value") > 0).alias("_transfer"), "from_address", "hash", fee_wei().cast("decimal(38,0)").alias("fee"), *([] if hot is None else [STORED_KEY]))
    rows = _classified_rows(base, contracts) if hot is None else _classified_stored(base, contracts, hot)
    tag = lambda t, v, fee: F.struct(F.lit(t).alias("t"), v.cast("string").alias("v"), fee.alias("fee"))
    pairs = F.array(tag(0, F.col("from_address"), F.lit(None).cast("decimal(38,0)")), tag(1, F.col("hash"), F.col("fee")))
    values = rows.select(PERIOD, "project", F.inline(pairs)).groupBy(PERIOD, "project", "t", "v").agg(F.sum("fee").alias("fee"))
    known = F.col("v").isNotNull()
    return values.groupBy(PERIOD, "project").agg(
        F.count_if(known & (F.col("t") == 0)).alias("num_unique_wallets"), F.count_if(known & (F.col("t") == 1)).alias("num_transactions"), F.sum("fee").alias("fee_wei"))


def project_charts(agg: DataFrame, labels: DataFrame, k: int = 10, min_wallets: int = 10) -> DataFrame:
    """The three project charts over one :func:`project_aggregate`: ``chart, date, project`` and the chart's measure (the other two are
    NULL). Every (period, project) row becomes a row per chart, and one ranking runs per chart and period."""
    row = lambda m, value, rank_by: F.struct(F.lit(m).alias("chart"), F.col(value).cast("decimal(38,0)").alias("_value"), F.col(rank_by).cast("decimal(38,0)").alias("_rank"))
    long_rows = agg.select(PERIOD, "project", "num_unique_wallets", F.inline(F.array(*[row(m, *of) for m, of in MEASURES.items()])))
    folded = top_k_other(long_rows, "_value", "_rank", "num_unique_wallets", k, min_wallets, ("chart", PERIOD))
    names = labels.select(F.col("address").alias("_address"), F.col("name").alias("_name"))
    labelled = folded.join(names, folded["project"] == names["_address"], "left").orderBy("chart", PERIOD, F.col("_value").desc(), "project")
    values = [F.when(F.col("chart") == m, amount("_value") if m == "eth_fees" else F.col("_value").cast("bigint")).alias(m) for m in MEASURES]
    return labelled.select("chart", long_label(PERIOD).alias("date"), F.coalesce("_name", "project").alias("project"), *values)


def ranked_chart(agg: DataFrame, labels: DataFrame, measure: str, k: int, min_wallets: int) -> DataFrame:
    """A project chart from its (period, project) aggregate."""
    value, rank_by = MEASURES[measure]
    folded = top_k_other(agg, value, rank_by, "num_unique_wallets", k, min_wallets)

    names = labels.select(F.col("address").alias("_address"), F.col("name").alias("_name"))
    out = amount(value).alias(measure) if measure == "eth_fees" else F.col(value).alias(measure)
    labelled = folded.join(names, folded["project"] == names["_address"], "left")
    return labelled.orderBy(PERIOD, F.col(value).desc(), "project").select(
        long_label(PERIOD).alias("date"), F.coalesce("_name", "project").alias("project"), out
    )
