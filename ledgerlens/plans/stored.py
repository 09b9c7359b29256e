"""User and deployer metrics from stored key sets (:mod:`ledgerlens.state.keysets`): same results as the direct plans.

``senders`` and ``key_deployers`` bring a state up to a clock; the metrics read it. Only the parts of days at the ends of a
trailing window, and the open day, are read from the facts. The two-period comparisons read a daily rollup in the same way.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import NEWLY_ACTIVE, RETURNING, growth_card
from ..operators.compare import APP, rank_apps, rank_trending, ranked_apps, two_period_from_pairs, two_period_pairs, window_parts
from ..operators.periods import labelled
from ..operators.ranking import project_aggregate
from ..operators.ranking import project_charts as _charts
from ..operators.retention import percentages
from ..operators.trailing import Window
from ..sources.bucketed import Targets
from ..sources.registry import Tables
from ..sources.schemas import EVENT_TIME, PARTITION_COLUMNS
from ..state import manifest
from ..state.keysets import KeySets, Source
from ..timeframe import Timeframe, as_datetime, ntz, shift, truncate
from .deployers import _key_rows
from .users import CARD_GROWTH_NAMES, CARD_WINDOWS, TX


def _source(tables: Tables, table: str, key: str, as_of: dt.datetime, chain: str | None = None) -> Source:
    ts = EVENT_TIME[table]

    def rows(since: dt.datetime | None, until: dt.datetime | None) -> DataFrame:
        t = tables.as_of(as_of).window(since, until, names=(table,))
        df = _key_rows(t, chain) if table == "deployments" else t[table]
        if since is not None:
            df = df.filter(F.col(ts) >= ntz(since))
        if until is not None:
            df = df.filter(F.col(ts) < ntz(until))
        return df.select(F.col(key).alias("key"), F.col(ts).alias("ts"))

    return rows


def changes(tables: Tables, table: str, seen: DataFrame, *columns: str, keep: str | None = None) -> tuple[DataFrame, list[dt.date]]:
    """(manifest of a fact table, days that changed since the manifest ``seen``): by files where the table is a Parquet folder, else by
    a digest of ``columns`` per day. With ``keep``, a new folder, the table is read for it once: what is compared and what is stored
    are the same rows."""
    ts = EVENT_TIME[table]
    if table in tables.paths:
        spark = seen.sparkSession
        now = manifest.of_files(spark, tables.paths[table], PARTITION_COLUMNS[table])
    else:
        now = manifest.of_rows(tables[table], ts, *columns)
    if keep is not None:
        now.write.parquet(keep)
        now = seen.sparkSession.read.schema(now.schema).parquet(keep)
    return manifest.compare(now, seen, ts)


def digested(tables: Tables, table: str, until: dt.datetime | None) -> bool:
    """Whether a build carries the digests of the days along: the first one of a table without files, of which every day is read."""
    return until is None and table not in tables.paths


def _refreshed(spark: SparkSession, tables: Tables, root: str, table: str, key: str, as_of: dt.datetime, columns: tuple[str, ...], chain: str | None = None) -> KeySets:
    state, source, closed = KeySets(spark, root), _source(tables, table, key, as_of, chain), truncate(as_of, Timeframe.DAY)
    if columns == (key,) and digested(tables, table, state.until):
        state.refresh(source, closed, digested=True)
    else:
        files, changed = changes(tables, table, state.seen_files(), *columns, keep=state.store.scratch("manifest"))
        state.refresh(source, closed, changed, files)
    return state


def senders(spark: SparkSession, tables: Tables, root: str, as_of) -> KeySets:
    """The senders of transactions, stored under ``root`` up to the day of ``as_of``."""
    return _refreshed(spark, tables, root, TX, "from_address", as_datetime(as_of), ("from_address",))


def key_deployers(spark: SparkSession, tables: Tables, root: str, as_of, chain: str | None) -> KeySets:
    """The qualified deployers of ``chain``, stored under ``root`` up to the day of ``as_of``."""
    columns = ("deployer", "chain", "token_type", "is_min_length", "is_used")
    return _refreshed(spark, tables, root, "deployments", "deployer", as_datetime(as_of), columns, chain)


def _windows(as_of: dt.datetime, windows: dict[str, Window]) -> dict[str, tuple[dt.datetime, dt.datetime | None]]:
    out: dict[str, tuple[dt.datetime, dt.datetime | None]] = {}
    for name, window in windows.items():
        one, two = window.bounds(as_of)
        out[f"{name}_cur"], out[f"{name}_prev"] = (one, None), (two, one)
    return out


def actives(state: KeySets, tables: Tables, as_of, n: int, unit: Timeframe | str) -> DataFrame:
    """Distinct senders in the last ``n`` units: ``active_wallets``."""
    as_of = as_datetime(as_of)
    source = _source(tables, TX, "from_address", as_of)
    return state.in_windows(source, as_of, {"active_wallets": (shift(as_of, -n, Timeframe.parse(unit)), None)})


def actives_growth(state: KeySets, tables: Tables, as_of, n: int, unit: Timeframe | str, out: str) -> DataFrame:
    as_of = as_datetime(as_of)
    counts = state.in_windows(_source(tables, TX, "from_address", as_of), as_of, _windows(as_of, {"w": Window(n, Timeframe.parse(unit))}))
    return counts.select(growth_card("w_cur", "w_prev").alias(out))


def cards(state: KeySets, tables: Tables, as_of) -> DataFrame:
    """All six cards in one pass over the sets and the windows' ends."""
    as_of = as_datetime(as_of)
    counts = state.in_windows(_source(tables, TX, "from_address", as_of), as_of, _windows(as_of, CARD_WINDOWS))
    cols = []
    for name in CARD_WINDOWS:
        cols += [F.col(f"{name}_cur").alias(f"actives_{name}"), growth_card(f"{name}_cur", f"{name}_prev").alias(f"actives_growth_{name}")]
    return counts.select(*cols)


def card_results(state: KeySets, tables: Tables, as_of) -> dict[str, DataFrame]:
    """The six cards under the dashboard's keys."""
    row = cards(state, tables, as_of)
    out = {f"actives_{name}": row.select(F.col(f"actives_{name}").alias("active_wallets")) for name in CARD_WINDOWS}
    return out | {f"actives_growth_{name}": row.select(F.col(f"actives_growth_{name}").alias(label)) for name, label in CARD_GROWTH_NAMES.items()}


def active_accounts_chart(state: KeySets, as_of, tf: Timeframe | str) -> DataFrame:
    """Distinct senders per complete period: ``date, active_wallets``."""
    tf = Timeframe.parse(tf)
    return labelled(state.per_period(tf, truncate(as_datetime(as_of), tf), "active_wallets"))


def retention_chart(state: KeySets, as_of, tf: Timeframe | str) -> DataFrame:
    """Cohort retention: ``cohort, total_users, {tf}_number, percentage``."""
    tf = Timeframe.parse(tf)
    return percentages(state.cohorts(tf, as_datetime(as_of), tf.retention_scope), tf)


def returning_key_deployers(state: KeySets, as_of, tf: Timeframe | str) -> DataFrame:
    """New and returning deployers per complete period: ``date, classification, num_accounts``."""
    tf = Timeframe.parse(tf)
    split = state.first_seen_split(tf, truncate(as_datetime(as_of), tf), Timeframe.WEEK)
    label = F.when(F.col("is_new"), F.lit(NEWLY_ACTIVE)).otherwise(F.lit(RETURNING))
    return labelled(split.select("_period", label.alias("classification"), "num_accounts"), then=("classification",))


def _edges(tables: Tables, as_of: dt.datetime, tf: Timeframe) -> DataFrame:
    """Transactions of the days that an end of the two windows divides."""
    _, days = window_parts(as_of, tf)
    t = tables.as_of(as_of)
    parts = [t.window(a, b - dt.timedelta(microseconds=1), names=(TX,))[TX].filter((F.col("block_timestamp") >= ntz(a)) & (F.col("block_timestamp") < ntz(b))) for a, b in days]
    return reduce(DataFrame.unionByName, parts)


def trending_contracts(activity: DataFrame, tables: Tables, as_of, tf: Timeframe | str, min_wallets: int = 10, limit: int = 20) -> DataFrame:
    """The trending table from the stored rollup ``target_activity`` (see :mod:`.rollups`) and the windows' divided days."""
    as_of, tf = as_datetime(as_of), Timeframe.parse(tf)
    pairs = two_period_pairs(activity, _edges(tables, as_of, tf), as_of, tf).withColumnRenamed("to_address", "contract")
    t = tables.as_of(as_of)
    return rank_trending(two_period_from_pairs(pairs, ["contract"]), t["contracts"], t["labels_apps"], min_wallets, limit)


def leaderboard(activity: DataFrame, tables: Tables, as_of, tf: Timeframe | str) -> DataFrame:
    """The app leaderboard from ``target_activity``: a wallet meets an app's labels once per address, not once per transaction."""
    as_of, tf = as_datetime(as_of), Timeframe.parse(tf)
    pairs = two_period_pairs(activity, _edges(tables, as_of, tf), as_of, tf)
    apps = pairs.join(ranked_apps(tables["labels_apps"]), F.col("to_address") == F.col("_address"))
    return rank_apps(two_period_from_pairs(apps, APP))


def project_rows(targets: Targets, as_of, tf: Timeframe | str) -> DataFrame:
    """``users.project_rows`` over the bucketed layout: the transactions meet the contracts without a shuffle."""
    as_of, part = as_datetime(as_of), PARTITION_COLUMNS[TX]
    tx = targets.transactions.where((F.col(part) <= F.lit(as_of.date())) & (F.col("block_timestamp") <= ntz(as_of)))
    return project_aggregate(tx, targets.contracts.where(F.col("block_timestamp") <= ntz(as_of)), tf, targets.hot)


def project_charts(targets: Targets, tables: Tables, as_of, tf: Timeframe | str, min_wallets: int = 10) -> DataFrame:
    """The three project charts over the bucketed layout: ``chart, date, project, num_transactions, eth_fees, num_unique_wallets``."""
    return _charts(project_rows(targets, as_of, tf), tables["labels_apps"], min_wallets=min_wallets)
