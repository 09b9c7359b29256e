"""Deployer and developer series: distinct deployers per period, qualified ("key") deployers, new versus
returning deployers, the qualified series of several chains side by side, and git commit activity.

Series are smoothed with a 3-row rolling mean over per-period aggregates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import key_deployment, period
from ..operators.periods import PERIOD, labelled, period_agg
from ..operators.series import align_series, first_seen_split, rolling_mean
from ..sources.registry import Tables
from ..timeframe import Timeframe, as_datetime, ntz, truncate

# Commit history starts on this day; series are averaged over 3 rows.
COMMITS_SINCE = dt.datetime(2023, 10, 7)
ROLLING_ROWS = 3


def _key_rows(tables: Tables, chain: str | None) -> DataFrame:
    rows = tables["deployments"].filter(key_deployment())
    return rows.filter(F.col("chain") == chain) if chain is not None else rows


def all_deployers(tables: Tables, as_of, tf: Timeframe | str) -> DataFrame:
    """Distinct contract deployers per complete period, 3-row mean: ``date, all_deployers``."""
    as_of, tf = as_datetime(as_of), Timeframe.parse(tf)
    agg = period_agg(tables.as_of(as_of)["contracts"], "block_timestamp", tf, [F.count_distinct("deployer").alias("all_deployers")], before=truncate(as_of, tf))
    return labelled(rolling_mean(agg, PERIOD, "all_deployers", ROLLING_ROWS))


def key_deployers(tables: Tables, as_of, tf: Timeframe | str, chain: str | None) -> DataFrame:
    """Distinct deployers of qualified deployments on ``chain`` per complete period, 3-row mean:
    ``date, filtered_deployers``."""
    as_of, tf = as_datetime(as_of), Timeframe.parse(tf)
    rows = _key_rows(tables.as_of(as_of), chain)
    agg = period_agg(rows, "created_at", tf, [F.count_distinct("deployer").alias("filtered_deployers")], before=truncate(as_of, tf))
    return labelled(rolling_mean(agg, PERIOD, "filtered_deployers", ROLLING_ROWS))


def returning_key_deployers(tables: Tables, as_of, tf: Timeframe | str, chain: str | None) -> DataFrame:
    """Qualified deployers per complete period split into newly active (deploying in the week of their first
    qualified deployment) and returning: ``date, classification, num_accounts``. The comparison is by week
    whatever the timeframe, so with months a deployer can be in both classes."""
    as_of, tf = as_datetime(as_of), Timeframe.parse(tf)
    rows = _key_rows(tables.as_of(as_of), chain)
    split = first_seen_split(rows, "deployer", "created_at", tf, truncate(as_of, tf), Timeframe.WEEK)
    return labelled(split, then=("classification",))


def chain_key_deployers(tables: Tables, as_of, tf: Timeframe | str, chains: tuple[str, ...]) -> DataFrame:
    """``key_deployers`` of several chains side by side (one column per chain), periods present in all chains:
    ``date, <chain>...``. One scan, one aggregate keyed by (chain, period), a per-chain window and a pivot."""
    as_of, tf = as_datetime(as_of), Timeframe.parse(tf)
    rows = tables.as_of(as_of)["deployments"].filter(key_deployment() & F.col("chain").isin(list(chains)))
    per_chain = (
        rows.filter(F.col("created_at") < ntz(truncate(as_of, tf)))
        .groupBy("chain", period("created_at", tf).alias(PERIOD))
        .agg(F.count_distinct("deployer").alias("n"))
    )
    rolled = rolling_mean(per_chain, PERIOD, "n", ROLLING_ROWS, partition="chain")
    return labelled(align_series(rolled, PERIOD, "chain", "n", chains))


def _commit_series(tables: Tables, as_of, tf, agg, out: str, since: dt.datetime) -> DataFrame:
    as_of, tf = as_datetime(as_of), Timeframe.parse(tf)
    # The cut is the start of the current *week* whatever the timeframe.
    series = period_agg(tables.as_of(as_of).window(since)["git_commits"], "date", tf, [agg.alias(out)], since=since, before=truncate(as_of, Timeframe.WEEK))
    return labelled(rolling_mean(series, PERIOD, out, ROLLING_ROWS))


def commits(tables: Tables, as_of, tf: Timeframe | str, since: dt.datetime = COMMITS_SINCE) -> DataFrame:
    """Commits per period since ``since``, 3-row mean: ``date, commits``."""
    return _commit_series(tables, as_of, tf, F.count(F.lit(1)), "commits", since)


def git_devs(tables: Tables, as_of, tf: Timeframe | str, since: dt.datetime = COMMITS_SINCE) -> DataFrame:
    """Distinct committers per period since ``since``, 3-row mean: ``date, active_devs``."""
    return _commit_series(tables, as_of, tf, F.count_distinct("username"), "active_devs", since)


def deployers_dashboard(tables: Tables, as_of, timeframe: Timeframe | str = Timeframe.WEEK, *, chain: str, chains: tuple[str, ...], key_sets=None) -> dict[str, DataFrame]:
    """All deployer metrics of one request; ``chain`` is the chain of the single-chain series, ``chains`` the
    columns of the side-by-side series. With ``key_sets`` (:func:`.stored.key_deployers`) the first-seen split reads no history."""
    from . import stored  # reads this module

    tf = Timeframe.parse(timeframe)
    return {
        "all_deployers": all_deployers(tables, as_of, tf),
        "key_deployers": key_deployers(tables, as_of, tf, chain),
        "returning_key_deployers": stored.returning_key_deployers(key_sets, as_of, tf) if key_sets else returning_key_deployers(tables, as_of, tf, chain),
        "chain_key_deployers": chain_key_deployers(tables, as_of, tf, chains),
    }


def developers_dashboard(tables: Tables, as_of, timeframe: Timeframe | str = Timeframe.WEEK) -> dict[str, DataFrame]:
    """Commit and active-developer series of one request."""
    tf = Timeframe.parse(timeframe)
    return {"commits": commits(tables, as_of, tf), "git_devs": git_devs(tables, as_of, tf)}
