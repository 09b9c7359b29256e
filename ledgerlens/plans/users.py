"""User metrics: activity cards, period charts, cohort retention, project charts and trending contracts.

Every function takes the (uncut) registry and an explicit ``as_of``; the registry is cut at ``as_of`` first, so
rows after the clock never leak into windows that have no upper bound of their own.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import period

from ..operators.compare import trending
from ..operators.periods import labelled, period_agg
from ..operators.ranking import project_aggregate, project_chart, ranked_chart
from ..operators.ranking import project_charts as _charts
from ..operators.retention import cohort_retention
from ..operators.trailing import Window, activity_cards, distinct_growth, trailing_distinct
from ..sources.registry import Tables
from ..timeframe import Timeframe, as_datetime, shift, truncate

TX = "transactions"

# The three cards of the users dashboard and their windows.
CARD_WINDOWS = {
    "24h": Window(1, Timeframe.DAY),
    "7d": Window(7, Timeframe.DAY),
    "1m": Window(1, Timeframe.MONTH),
}
CARD_GROWTH_NAMES = {"24h": "daily_growth", "7d": "weekly_growth", "1m": "monthly_growth"}


def actives(tables: Tables, as_of, n: int, unit: Timeframe | str) -> DataFrame:
    """Distinct senders in the last ``n`` units (cards ``actives_24h``, ``actives_7d``, ``actives_1m``)."""
    as_of = as_datetime(as_of)
    t = tables.as_of(as_of).window(shift(as_of, -n, Timeframe.parse(unit)), names=(TX,))
    return trailing_distinct(t[TX], "from_address", "block_timestamp", as_of, n, unit, "active_wallets")


def actives_growth(tables: Tables, as_of, n: int, unit: Timeframe | str, out: str) -> DataFrame:
    """Growth of distinct senders over the previous window (cards ``actives_growth_*``)."""
    as_of = as_datetime(as_of)
    t = tables.as_of(as_of).window(shift(as_of, -2 * n, Timeframe.parse(unit)), names=(TX,))
    return distinct_growth(t[TX], "from_address", "block_timestamp", as_of, n, unit, out)


def cards(tables: Tables, as_of) -> DataFrame:
    """All six cards in one scan: ``actives_24h, actives_growth_24h, actives_7d, ..., actives_growth_1m``."""
    as_of = as_datetime(as_of)
    since = min(w.bounds(as_of)[1] for w in CARD_WINDOWS.values())
    t = tables.as_of(as_of).window(since, names=(TX,))
    return activity_cards(t[TX], "from_address", "block_timestamp", as_of, CARD_WINDOWS)


def daily_activity(tables: Tables, as_of, more: tuple[Column, ...] = ()) -> DataFrame:
    """Rollup of transactions to one row per (day, sender): ``day, from_address, transactions``, and the aggregates ``more``.

    Distinct senders are not additive across days, so the rollup keeps the sender; it is much smaller than the
    transactions (one row per active sender and day) and serves every chart whose period cut is a day boundary.
    NULL senders are kept (they count as transactions, not as wallets).
    """
    tx = tables.as_of(as_datetime(as_of))[TX]
    return tx.groupBy(period("block_timestamp", Timeframe.DAY).alias("day"), "from_address").agg(F.count(F.lit(1)).alias("transactions"), *more)


def _activity(tables: Tables, as_of: dt.datetime, activity: DataFrame | None) -> tuple[DataFrame, str, Column]:
    """(rows, timestamp column, transaction-count expression) from the rollup when given, else from transactions."""
    if activity is not None:
        return activity, "day", F.sum("transactions")
    return tables.as_of(as_of)[TX], "block_timestamp", F.count(F.lit(1))


def active_accounts_chart(tables: Tables, as_of, tf: Timeframe | str, activity: DataFrame | None = None) -> DataFrame:
    """Distinct senders per complete period: ``date, active_wallets``."""
    as_of, tf = as_datetime(as_of), Timeframe.parse(tf)
    rows, ts, _ = _activity(tables, as_of, activity)
    agg = period_agg(rows, ts, tf, [F.count_distinct("from_address").alias("active_wallets")], before=truncate(as_of, tf))
    return labelled(agg)


def transactions_chart(tables: Tables, as_of, tf: Timeframe | str, activity: DataFrame | None = None) -> DataFrame:
    """Transactions per complete period: ``date, transactions``."""
    as_of, tf = as_datetime(as_of), Timeframe.parse(tf)
    rows, ts, count = _activity(tables, as_of, activity)
    agg = period_agg(rows, ts, tf, [count.cast("bigint").alias("transactions")], before=truncate(as_of, tf))
    return labelled(agg)


def retention_chart(tables: Tables, as_of, tf: Timeframe | str, activity: DataFrame | None = None) -> DataFrame:
    """Cohort retention of senders: ``cohort, total_users, {tf}_number, percentage``."""
    as_of, tf = as_datetime(as_of), Timeframe.parse(tf)
    rows, ts, _ = _activity(tables, as_of, activity)
    return cohort_retention(rows, "from_address", ts, tf, as_of, tf.retention_scope)


def _project_chart(tables: Tables, as_of, tf, measure: str, min_wallets: int) -> DataFrame:
    as_of, tf = as_datetime(as_of), Timeframe.parse(tf)
    t = tables.as_of(as_of)
    return project_chart(t[TX], t["contracts"], t["labels_apps"], tf, measure, min_wallets=min_wallets)


def project_rows(tables: Tables, as_of, tf: Timeframe | str) -> DataFrame:
    """The aggregate behind all three project charts, one row per period and project (see ``ranking.project_aggregate``). Stored by
    the publisher, it saves two of three scans and contract joins."""
    t = tables.as_of(as_datetime(as_of))
    return project_aggregate(t[TX], t["contracts"], tf)


def project_charts(tables: Tables, as_of, tf: Timeframe | str, min_wallets: int = 10) -> DataFrame:
    """The three project charts in one pass: ``chart, date, project, num_transactions, eth_fees, num_unique_wallets``."""
    return _charts(project_rows(tables, as_of, tf), tables["labels_apps"], min_wallets=min_wallets)


def contract_transactions_chart(tables: Tables, as_of, tf: Timeframe | str, min_wallets: int = 10) -> DataFrame:
    """Distinct transactions per period for the top 10 projects by wallets, the rest as ``Other``; projects with at
    most ``min_wallets`` wallets are left out: ``date, project, num_transactions``."""
    return _project_chart(tables, as_of, tf, "num_transactions", min_wallets)


def contract_gas_chart(tables: Tables, as_of, tf: Timeframe | str, min_wallets: int = 10) -> DataFrame:
    """ETH fees per period for the top 10 projects by fees, the rest as ``Other``: ``date, project, eth_fees``."""
    return _project_chart(tables, as_of, tf, "eth_fees", min_wallets)


def contract_users_chart(tables: Tables, as_of, tf: Timeframe | str, min_wallets: int = 10) -> DataFrame:
    """Distinct wallets per period for the top 10 projects by wallets; ``Other`` sums wallets of the rest (a
    wallet can count in several projects): ``date, project, num_unique_wallets``."""
    return _project_chart(tables, as_of, tf, "num_unique_wallets", min_wallets)


def trending_contracts(tables: Tables, as_of, tf: Timeframe | str, min_wallets: int = 10, limit: int = 20) -> DataFrame:
    """Contracts with more than ``min_wallets`` wallets in the previous period and more wallets now; top ``limit``
    by current transactions."""
    as_of, tf = as_datetime(as_of), Timeframe.parse(tf)
    t = tables.as_of(as_of).window(shift(as_of, -2, tf), names=(TX,))
    return trending(t[TX], t["contracts"], t["labels_apps"], as_of, tf, min_wallets, limit)


def stamp(as_of) -> str:
    """Not a query: the ``dd/MM/yy HH:mm`` stamp of a dashboard, from ``as_of``."""
    return as_datetime(as_of).strftime("%d/%m/%y %H:%M")


def dashboard(tables: Tables, as_of, timeframe: Timeframe | str = Timeframe.WEEK, activity: DataFrame | None = None, senders=None, targets: DataFrame | None = None, projects: DataFrame | None = None) -> dict:
    """All user metrics of one request, under the original response keys; plans only, no job runs here. Stored state replaces
    the transaction history where it is given: ``activity``, a (day, sender) rollup, for the three all-history charts; ``senders``, the
    key sets of :mod:`.stored`, for the cards and the charts of distinct senders; ``targets``, the (day, target, sender) rollup,
    for the trending table (see :mod:`.rollups`); ``projects``, a stored :func:`project_rows`, for the project charts."""
    from . import stored  # reads this module

    as_of, tf = as_datetime(as_of), Timeframe.parse(timeframe)
    if senders is not None:
        card_keys = stored.card_results(senders, tables, as_of)
    else:
        card_row = cards(tables, as_of)  # each key below prunes it to its own windows
        card_keys = {f"actives_{name}": card_row.select(F.col(f"actives_{name}").alias("active_wallets")) for name in CARD_WINDOWS}
        card_keys.update({f"actives_growth_{name}": card_row.select(F.col(f"actives_growth_{name}").alias(out)) for name, out in CARD_GROWTH_NAMES.items()})
    return {
        "time": stamp(as_of),
        **card_keys,
        "active_accounts_chart": stored.active_accounts_chart(senders, as_of, tf) if senders else active_accounts_chart(tables, as_of, tf, activity),
        "transactions_chart": transactions_chart(tables, as_of, tf, activity),
        "retention_chart": stored.retention_chart(senders, as_of, tf) if senders else retention_chart(tables, as_of, tf, activity),
        "contract_transactions_chart": contract_transactions_chart(tables, as_of, tf) if projects is None else ranked_chart(projects, tables["labels_apps"], "num_transactions", 10, 10),
        "contract_gas_chart": contract_gas_chart(tables, as_of, tf) if projects is None else ranked_chart(projects, tables["labels_apps"], "eth_fees", 10, 10),
        "trending_contracts": trending_contracts(tables, as_of, tf) if targets is None else stored.trending_contracts(targets, tables, as_of, tf),
    }


__all__ = [
    "actives",
    "actives_growth",
    "cards",
    "active_accounts_chart",
    "transactions_chart",
    "retention_chart",
    "contract_transactions_chart",
    "contract_gas_chart",
    "contract_users_chart",
    "project_rows",
    "project_charts",
    "trending_contracts",
    "daily_activity",
    "dashboard",
]
