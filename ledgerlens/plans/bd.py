"""Business-development views: the app leaderboard, its labelled slugs and the leaderboard with locked value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.compare import leaderboard as _leaderboard
from ..operators.enrich import enrich_json
from ..sources.registry import Tables
from ..timeframe import Timeframe, as_datetime, shift


def leaderboard(tables: Tables, as_of, tf: Timeframe | str = Timeframe.MONTH) -> DataFrame:
    """Per app: ``project, slug, category, eth_fees, eth_fees_growth, transactions, transactions_growth, wallets,
    wallets_growth``; growth is 0 when the app had no activity in the previous period."""
    as_of, tf = as_datetime(as_of), Timeframe.parse(tf)
    t = tables.as_of(as_of).window(shift(as_of, -2, tf), names=("transactions",))
    return _leaderboard(t["transactions"], t["labels_apps"], as_of, tf)


def slugs(tables: Tables) -> DataFrame:
    """Distinct non-NULL app slugs."""
    return tables["labels_apps"].select("slug").filter(F.col("slug").isNotNull()).distinct()


def leaderboard_tvl(tables: Tables, as_of, tf: Timeframe | str, chain_key: str) -> DataFrame:
    """The leaderboard with ``tvl``: the ``currentChainTvls.<chain_key>`` value of the app's protocol payload,
    NULL when the slug is NULL, has no payload, or the payload has no such chain."""
    board = leaderboard(tables, as_of, tf)
    out = enrich_json(board, tables["protocol_tvl"], "slug", f"$.currentChainTvls.{chain_key}", "tvl")
    return out.orderBy(F.col("eth_fees").desc_nulls_last(), "project", "slug", "category")


def dashboard(tables: Tables, as_of, timeframe: Timeframe | str = Timeframe.MONTH, targets: DataFrame | None = None) -> dict[str, DataFrame]:
    """The leaderboard; with ``targets``, the stored (day, target, sender) rollup, whole days are not read from the transactions."""
    from . import stored  # reads the operators of this module

    return {"leaderboard": leaderboard(tables, as_of, timeframe) if targets is None else stored.leaderboard(targets, tables, as_of, timeframe)}
