"""Registered queries over the driver's test tables: name -> (Spark callable, oracle SQL).

Each reference metric is registered once per timeframe it supports, with the fixed clocks of the fixtures. The
Spark side always goes through the public metric functions in :mod:`ledgerlens.plans`; the SQL side is the
independent restatement in :mod:`ledgerlens.oracle`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import oracle as sql
from .plans import bd, deployers, economics, report, rollups, stored, users
from .session import shared_dir
from .sources import bucketed
from .sources import fixtures as fx
from .sources.payloads import write_payloads
from .timeframe import Timeframe

TIMEFRAMES = ("day", "week", "month")


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    endpoint: str
    headline: bool = False


def _long(spark: SparkSession, sf_dir: str):
    return fx.long_history(spark, sf_dir)


def _intraday(spark: SparkSession, sf_dir: str):
    return fx.intraday(spark, sf_dir)


def _state_dir(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where a session keeps the state of one fixture: built by the first query that reads it, refreshed by the others."""
    return f"{shared_dir(spark)}/state-{spark.sparkContext.applicationId}/{zlib.crc32(sf_dir.encode()):08x}/{name}"


def _senders(fixture: Callable, as_of):
    def state(spark: SparkSession, sf_dir: str):
        tables = fixture(spark, sf_dir)
        return stored.senders(spark, tables, _state_dir(spark, sf_dir, f"senders-{fixture.__name__}"), as_of), tables

    return state


def _rollup(fixture: Callable, name: str, as_of):
    def rows(spark: SparkSession, sf_dir: str):
        tables, root = fixture(spark, sf_dir), _state_dir(spark, sf_dir, f"rollups-{fixture.__name__}")
        rollups.refresh(spark, tables, root, as_of, (name,))
        return rollups.read(spark, tables, root, name, as_of), tables

    return rows


def _by_target(fixture: Callable):
    """Transactions and contracts of a fixture in the bucketed layout, written once a session."""

    def targets(spark: SparkSession, sf_dir: str):
        tables, root = fixture(spark, sf_dir), _state_dir(spark, sf_dir, f"targets-{fixture.__name__}")
        prefix = f"targets_{fixture.__name__}_{zlib.crc32(root.encode()):08x}"
        if bucketed.is_stored(spark, prefix):
            return bucketed.read_targets(spark, prefix), tables
        return bucketed.write_targets(spark, tables["transactions"], tables["contracts"], prefix, 8, root=root), tables

    return targets


def _payload_feed(spark: SparkSession, sf_dir: str):
    """The long history with its protocol payloads written as one document per slug and read back as such."""
    tables, folder = _long(spark, sf_dir), _state_dir(spark, sf_dir, "payloads")
    write_payloads(tables["protocol_tvl"], folder)
    return tables.with_payload_folder(spark, folder)


# Default timeframe of each dashboard (the bench times these).
DEFAULT_TF = {"users": "week", "bd": "month", "economics": "month", "deployers": "week", "developers": "week"}


def _with_hours(metric: Callable, found: tuple, as_of, window: str) -> DataFrame:
    hours, tables = found
    return metric(tables, as_of, window, hours)


def catalog() -> dict[str, Entry]:
    L, R, I, C = fx.LONG_AS_OF, fx.RETENTION_AS_OF, fx.INTRADAY_AS_OF, fx.COMMITS_AS_OF
    out: dict[str, Entry] = {}

    def add(name, run, oracle_sql, endpoint, tf=None):
        headline = endpoint not in ("stored", "users one pass") and (tf is None or DEFAULT_TF.get(endpoint) == tf)
        out[name] = Entry(run, oracle_sql, endpoint, headline)

    # users: cards
    add("actives_24h", lambda s, d: users.actives(_intraday(s, d), I, 1, "day"), sql.actives(I, "1 DAY", "intraday"), "users")
    add("actives_growth_24h", lambda s, d: users.actives_growth(_intraday(s, d), I, 1, "day", "daily_growth"),
        sql.actives_growth(I, "1 DAY", "2 DAY", "daily_growth", "intraday"), "users")
    add("actives_7d", lambda s, d: users.actives(_intraday(s, d), I, 7, "day"), sql.actives(I, "7 DAY", "intraday"), "users")
    add("actives_growth_7d", lambda s, d: users.actives_growth(_intraday(s, d), I, 7, "day", "weekly_growth"),
        sql.actives_growth(I, "7 DAY", "14 DAY", "weekly_growth", "intraday"), "users")
    add("actives_1m", lambda s, d: users.actives(_long(s, d), L, 1, "month"), sql.actives(L, "1 MONTH", "long"), "users")
    add("actives_growth_1m", lambda s, d: users.actives_growth(_long(s, d), L, 1, "month", "monthly_growth"),
        sql.actives_growth(L, "1 MONTH", "2 MONTH", "monthly_growth", "long"), "users")
    add("user_cards", lambda s, d: users.cards(_intraday(s, d), I), sql.user_cards(I, "intraday"), "users")

    for tf in TIMEFRAMES:
        add(f"active_accounts_chart_{tf}", lambda s, d, tf=tf: users.active_accounts_chart(_long(s, d), L, tf), sql.active_accounts_chart(L, tf), "users", tf)
        add(f"transactions_chart_{tf}", lambda s, d, tf=tf: users.transactions_chart(_long(s, d), L, tf), sql.transactions_chart(L, tf), "users", tf)
        add(f"retention_chart_{tf}", lambda s, d, tf=tf: users.retention_chart(fx.late_senders(s, d), L, tf),
            sql.retention_chart(L, tf, Timeframe(tf).retention_scope, "late"), "users", tf)
        add(f"retention_chart_{tf}_young", lambda s, d, tf=tf: users.retention_chart(_long(s, d), R, tf),
            sql.retention_chart(R, tf, Timeframe(tf).retention_scope), "users", "day" if tf != "day" else "month")
        # Few wallets meet a project on one day of the long history: the finer charts read the dense one.
        busy, variant = (fx.dense, "dense") if tf == "day" else (_long, "long")
        for chart, measure in (("contract_transactions_chart", "num_transactions"), ("contract_gas_chart", "eth_fees"), ("contract_users_chart", "num_unique_wallets")):
            add(f"{chart}_{tf}", lambda s, d, tf=tf, fn=getattr(users, chart), busy=busy: fn(busy(s, d), L, tf), sql.project_chart(L, tf, measure, variant=variant), "users", tf)
        add(f"project_charts_{tf}", lambda s, d, tf=tf, busy=busy: users.project_charts(busy(s, d), L, tf), sql.project_charts(L, tf, variant), "users one pass", tf)
        busy, variant = (_long, "long") if tf == "month" else (fx.dense, "dense")
        add(f"trending_contracts_{tf}", lambda s, d, tf=tf, busy=busy: users.trending_contracts(busy(s, d), L, tf), sql.trending_contracts(L, tf, variant=variant), "users", tf)

    # The same charts with every project kept (threshold 0): at day granularity the default threshold of 10
    # wallets leaves the fixtures empty, these exercise ranking ties and the Other fold per day.
    for chart, measure in (("contract_transactions_chart", "num_transactions"), ("contract_gas_chart", "eth_fees"), ("contract_users_chart", "num_unique_wallets")):
        fn = getattr(users, chart)
        add(f"{chart}_day_all_projects", lambda s, d, fn=fn: fn(_long(s, d), L, "day", min_wallets=0), sql.project_chart(L, "day", measure, 0), "users", "day")
    add("trending_contracts_week_all_previous", lambda s, d: users.trending_contracts(_long(s, d), L, "week", min_wallets=0),
        sql.trending_contracts(L, "week", min_wallets=0), "users", "day")

    # bd
    for tf in TIMEFRAMES:
        add(f"leaderboard_{tf}", lambda s, d, tf=tf: bd.leaderboard(_long(s, d), L, tf), sql.leaderboard(L, tf), "bd", tf)
    add("slugs", lambda s, d: bd.slugs(_long(s, d)), sql.slugs(), "bd")
    add("leaderboard_tvl", lambda s, d: bd.leaderboard_tvl(_long(s, d), L, "month", fx.FIXTURE_TVL_CHAIN), sql.leaderboard_tvl(L, "month"), "bd")

    add("leaderboard_tvl_feed", lambda s, d: bd.leaderboard_tvl(_payload_feed(s, d), L, "month", fx.FIXTURE_TVL_CHAIN), sql.leaderboard_tvl(L, "month"), "stored")

    # economics
    for tf in TIMEFRAMES:
        add(f"gross_profit_{tf}", lambda s, d, tf=tf: economics.gross_profit(_long(s, d), L, tf), sql.gross_profit(L, tf), "economics", tf)
        add(f"batch_fees_{tf}", lambda s, d, tf=tf: economics.batch_fees(_long(s, d), L, tf),
            sql.cost_chart(L, tf, "l1_batch_fees", "batch_fees"), "economics", tf)
        add(f"verify_fees_{tf}", lambda s, d, tf=tf: economics.verify_fees(_long(s, d), L, tf),
            sql.cost_chart(L, tf, "l1_verification_fees", "verification_fees"), "economics", tf)
        add(f"gas_revenue_{tf}", lambda s, d, tf=tf: economics.gas_revenue(_long(s, d), L, tf), sql.gas_revenue(L, tf), "economics", tf)
        add(f"l1vl2fee_{tf}", lambda s, d, tf=tf: economics.l1vl2fee(_long(s, d), L, tf), sql.l1vl2fee(L, tf), "economics", tf)
    add("gas_revenue_intraday_day", lambda s, d: economics.gas_revenue(_intraday(s, d), I, "day"), sql.gas_revenue(I, "day", "intraday"), "economics", "day")
    add("gross_profit_intraday_day", lambda s, d: economics.gross_profit(_intraday(s, d), I, "day"), sql.gross_profit(I, "day", "intraday"), "economics", "day")
    for window, interval in (("week", "1 WEEK"), ("month", "1 MONTH"), ("all", None)):
        add(f"{window}_gross_profit", lambda s, d, w=window: economics.scalar_profit(_long(s, d), L, w), sql.scalar_profit(L, interval), "economics")
        add(f"{window}_revenue", lambda s, d, w=window: economics.scalar_revenue(_long(s, d), L, w), sql.scalar_revenue(L, interval), "economics")

    # deployers
    chain = fx.FIXTURE_CHAINS[0]
    for tf in TIMEFRAMES:
        add(f"all_deployers_{tf}", lambda s, d, tf=tf: deployers.all_deployers(_long(s, d), L, tf), sql.all_deployers(L, tf), "deployers", tf)
        add(f"key_deployers_{tf}", lambda s, d, tf=tf: deployers.key_deployers(_long(s, d), L, tf, chain), sql.key_deployers(L, tf, chain), "deployers", tf)
        add(f"returning_key_deployers_{tf}", lambda s, d, tf=tf: deployers.returning_key_deployers(_long(s, d), L, tf, chain),
            sql.returning_key_deployers(L, tf, chain), "deployers", tf)
        add(f"chain_key_deployers_{tf}", lambda s, d, tf=tf: deployers.chain_key_deployers(_long(s, d), L, tf, fx.FIXTURE_CHAINS),
            sql.chain_key_deployers(L, tf, fx.FIXTURE_CHAINS), "deployers", tf)

    # developers
    since = deployers.COMMITS_SINCE
    for tf in TIMEFRAMES:
        add(f"commits_{tf}", lambda s, d, tf=tf: deployers.commits(_long(s, d), C, tf), sql.commits(C, tf, since, False), "developers", tf)
        add(f"git_devs_{tf}", lambda s, d, tf=tf: deployers.git_devs(_long(s, d), C, tf), sql.commits(C, tf, since, True), "developers", tf)

    # the same metrics from stored key sets and rollups
    senders, late, targets, hourly = _senders(fx.intraday, I), _senders(fx.late_senders, L), _rollup(fx.dense, "target_activity", L), _rollup(fx.long_history, "hourly_fees", L)
    add("stored_user_cards", lambda s, d: stored.cards(*senders(s, d), I), sql.user_cards(I, "intraday"), "stored")
    for card, n, unit, back, out_name in (("24h", 1, "day", "1 DAY", "daily_growth"), ("7d", 7, "day", "7 DAY", "weekly_growth")):
        add(f"stored_actives_{card}", lambda s, d, n=n, unit=unit: stored.actives(*senders(s, d), I, n, unit), sql.actives(I, back, "intraday"), "stored")
        add(f"stored_actives_growth_{card}", lambda s, d, n=n, unit=unit, out_name=out_name: stored.actives_growth(*senders(s, d), I, n, unit, out_name),
            sql.actives_growth(I, back, f"{2 * n} DAY", out_name, "intraday"), "stored")
    for tf in TIMEFRAMES:
        add(f"stored_active_accounts_chart_{tf}", lambda s, d, tf=tf: stored.active_accounts_chart(late(s, d)[0], L, tf), sql.active_accounts_chart(L, tf, "late"), "stored", tf)
        add(f"stored_retention_chart_{tf}", lambda s, d, tf=tf: stored.retention_chart(late(s, d)[0], L, tf), sql.retention_chart(L, tf, Timeframe(tf).retention_scope, "late"), "stored", tf)
        add(f"stored_returning_key_deployers_{tf}", lambda s, d, tf=tf: stored.returning_key_deployers(stored.key_deployers(s, _long(s, d), _state_dir(s, d, "key_deployers"), L, chain), L, tf),
            sql.returning_key_deployers(L, tf, chain), "stored", tf)
    for tf in ("day", "week"):
        add(f"stored_trending_contracts_{tf}", lambda s, d, tf=tf: stored.trending_contracts(*targets(s, d), L, tf), sql.trending_contracts(L, tf, variant="dense"), "stored", tf)
    by_target = _by_target(fx.dense)
    for tf in ("day", "week"):
        add(f"stored_project_charts_{tf}", lambda s, d, tf=tf: stored.project_charts(*by_target(s, d), L, tf), sql.project_charts(L, tf, "dense"), "stored", tf)
    for window, interval in (("week", "1 WEEK"), ("month", "1 MONTH"), ("all", None)):
        add(f"stored_{window}_revenue", lambda s, d, w=window: _with_hours(economics.scalar_revenue, hourly(s, d), L, w), sql.scalar_revenue(L, interval), "stored")
        add(f"stored_{window}_gross_profit", lambda s, d, w=window: _with_hours(economics.scalar_profit, hourly(s, d), L, w), sql.scalar_profit(L, interval), "stored")

    # report
    add("report", lambda s, d: report.report(_long(s, d), fx.REPORT_START, fx.REPORT_END, L), sql.report(L, fx.REPORT_START, fx.REPORT_END), "econ_report")
    return out
