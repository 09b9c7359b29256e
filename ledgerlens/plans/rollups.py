"""Stored rollups: daily aggregates that dashboards read instead of the whole transaction history.

``daily_activity`` (day, sender, transactions) serves the all-history user charts, ``hourly_fees`` the economics series and, with the
facts of the partial hours at their ends, the trailing cards; ``target_activity`` (day, target, sender, transactions, fees) the two-period
comparisons. A refresh rewrites the closed days that changed since the last one, found from the manifest of the table's files (new,
replaced or gone ones; see :mod:`ledgerlens.state.manifest`), however late their rows came, and reads those days' partitions only. Days are
committed together (:mod:`ledgerlens.state.versions`), so readers never see half a refresh. Reading adds the days that are not stored,
the open one first of all, from the transactions, so a rollup equals the direct aggregate at any clock.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import target_activity
from ..sources.registry import Tables
from ..state import manifest
from ..state.keysets import runs_of
from ..state.versions import Commit, Versions
from ..timeframe import Timeframe, as_datetime, ntz, truncate
from . import economics, stored, users

TX = "transactions"
FILES = "file string, modified timestamp, size long, day date"
# Rollup name -> (aggregate of the transactions at a clock, its time column, its columns, the transactions' columns it depends on).
ROLLUPS = {
    "daily_activity": (users.daily_activity, "day", "day timestamp_ntz, from_address string, transactions long", ("from_address",)),
    "hourly_fees": (economics.hourly_fees, "hour", "hour timestamp_ntz, priced_gas boolean, rev_wei decimal(38,0), l1_wei decimal(38,0), l2_wei decimal(38,0), transactions long",
                    ("receipt_l1_fee", "receipt_effective_gas_price", "receipt_gas_used")),
    "target_activity": (lambda tables, as_of, more=(): target_activity(tables.as_of(as_datetime(as_of))[TX], more), "day",
                        "day timestamp_ntz, to_address string, from_address string, transactions long, fee_wei decimal(38,0)",
                        ("to_address", "from_address", "hash", "receipt_l1_fee", "receipt_effective_gas_price", "receipt_gas_used")),
}


def _store(spark: SparkSession, root: str, name: str) -> Versions:
    return Versions(spark, f"{root.rstrip('/')}/{name}", {"rows": ROLLUPS[name][2], "files": FILES})


def _rows(tables: Tables, name: str, as_of: dt.datetime, since: dt.datetime | None, until: dt.datetime | None, digested: bool = False) -> DataFrame:
    """The rollup of the transactions with ``since <= time < until`` known at ``as_of``, as it is stored; ``digested`` adds the number of
    transactions and their digest for the manifest (``_size``, ``_digest``)."""
    tx = tables.window(since, until, names=(TX,))[TX]
    if since is not None:
        tx = tx.filter(F.col("block_timestamp") >= ntz(since))
    if until is not None:
        tx = tx.filter(F.col("block_timestamp") < ntz(until))
    build, _, columns, needs = ROLLUPS[name]
    more = (F.count(F.lit(1)).alias("_size"), F.sum(manifest.row_digest(*needs)).alias("_digest")) if digested else ()
    made = build(tables.with_tables(**{TX: tx}), as_of, more)
    return made.select(*[F.col(c).cast(kind).alias(c) for c, kind in (x.split(" ") for x in columns.split(", "))], *(["_size", "_digest"] if digested else []))


def refresh(spark: SparkSession, tables: Tables, root: str, as_of=None, names: tuple[str, ...] = tuple(ROLLUPS)) -> dict[str, list[dt.date]]:
    """Bring the stored rollups up to the start of the day of ``as_of``; returns the days written again."""
    as_of = as_datetime(as_of)
    closed = truncate(as_of, Timeframe.DAY)
    return {name: _refresh(spark, tables, root, name, as_of, closed) for name in names}


def _refresh(spark: SparkSession, tables: Tables, root: str, name: str, as_of: dt.datetime, closed: dt.datetime) -> list[dt.date]:
    store = _store(spark, root, name)
    was = store.latest()
    until = dt.datetime.fromisoformat(was.facts["until"]) if was.facts else None
    digested = stored.digested(tables, TX, until)
    files, changed = (None, []) if digested else stored.changes(tables, TX, store.read_parts("files", was.live["files"]), *ROLLUPS[name][3], keep=store.scratch("manifest"))
    if until is None:
        days, rows = set(), _rows(tables, name, as_of, None, closed, digested)
    else:
        days = {d for d in changed if as_datetime(d) < closed}
        days |= {(until + dt.timedelta(days=k)).date() for k in range(max(0, (closed - until).days))}
        if not days:
            return []
        rows = reduce(DataFrame.unionByName, [_rows(tables, name, as_of, a, b) for a, b in runs_of(days)])
    rows = rows.withColumn("block_date", F.to_date(ROLLUPS[name][1]))
    if days:
        rows = rows.filter(F.col("block_date").isin(sorted(days)))
    version = store.new_version()
    have = store.write("rows", version, rows, dealt=True)
    if digested:
        written = spark.read.schema("block_date date, _size long, _digest long").parquet(f"{store.root}/rows/version={version}")
        files = manifest.of_digests(written.select(F.col("block_date").alias("day"), F.col("_size").alias("size"), F.col("_digest").alias("digest")))
    live = {day: v for day, v in was.live["rows"].items() if day not in days} | dict.fromkeys(have, version)
    parts: dict[dt.date, str] = {}
    store.add_part("files", version, files, parts)
    store.publish(version, Commit({"rows": live, "files": parts}, {"until": max(closed, until or closed).isoformat()}))
    return sorted(days | have)


def read(spark: SparkSession, tables: Tables, root: str, name: str, as_of=None) -> DataFrame:
    """The rollup at ``as_of``: stored days before its day, and the days since the last refresh from the transactions."""
    as_of = as_datetime(as_of)
    store = _store(spark, root, name)
    commit = store.latest()
    if not commit.facts:
        return _rows(tables, name, as_of, None, None)
    since = min(truncate(as_of, Timeframe.DAY), dt.datetime.fromisoformat(commit.facts["until"]))
    live = _rows(tables, name, as_of, since, None)
    return store.read("rows", commit).filter(F.col("block_date") < F.lit(since.date())).select(*live.columns).unionByName(live)
