"""Scheduled publishing of dashboards.

Without ``rollup_dir`` dashboards are recomputed from the full tables. With it, rollups and key sets stored there are refreshed from the
days whose files changed, and the dashboards read those (distinct wallets are merged as exact bitmaps). A Structured Streaming query over the transaction folder acts as the scheduler: every trigger interval
(six hours by default, the lifetime of a published result) in which new transaction files arrived, the micro-batch
recomputes the requested dashboards at ``as_of`` and publishes them as new versions. The stream's progress lives in
the shared checkpoint folder named by ``spark.checkpoint.dir``, so a restarted driver resumes where it stopped and
lost executors only re-run tasks.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import bd, deployers, economics, report, rollups, stored, users
from ..plans.sink import write_dashboard
from ..sources.registry import Tables
from ..sources.schemas import SCHEMAS
from ..timeframe import Timeframe, now

DEFAULT_INTERVAL = "6 hours"

# Dashboards by name: each takes (tables, as_of, timeframe, **options); ``deployers`` needs ``chain`` and ``chains``,
# ``econ_report`` needs ``start`` and ``end``.
DASHBOARDS: dict[str, Callable[..., dict]] = {
    "users": users.dashboard,
    "bd": bd.dashboard,
    "economics": economics.dashboard,
    "deployers": deployers.deployers_dashboard,
    "developers": deployers.developers_dashboard,
    "econ_report": lambda tables, as_of, timeframe, *, start, end: report.dashboard(tables, start, end, as_of),
}
# Stored rollups a dashboard can read, by the argument that takes each.
USES = {"users": {"activity": "daily_activity", "targets": "target_activity"}, "bd": {"targets": "target_activity"}, "economics": {"hourly": "hourly_fees"}}


def _stored(spark: SparkSession, tables: Tables, root: str, name: str, as_of: dt.datetime, timeframe, options: dict) -> dict:
    """The stored state a dashboard reads, brought up to ``as_of``."""
    out = {}
    for argument, rollup in USES.get(name, {}).items():
        rollups.refresh(spark, tables, root, as_of, (rollup,))
        out[argument] = rollups.read(spark, tables, root, rollup, as_of)
    if name == "users":
        # The three project charts read one stored aggregate: a row per period and project.
        path = f"{root.rstrip('/')}/projects/{uuid.uuid4().hex}"
        users.project_rows(tables, as_of, timeframe).write.parquet(path)
        out["projects"] = spark.read.parquet(path)
        out["senders"] = stored.senders(spark, tables, f"{root.rstrip('/')}/senders", as_of)
    if name == "deployers":
        out["key_sets"] = stored.key_deployers(spark, tables, f"{root.rstrip('/')}/key_deployers-{options['chain']}", as_of, options["chain"])
    return out


def publish(
    tables: Tables,
    as_of: dt.datetime,
    out_dir: str,
    timeframe: Timeframe | str,
    names: list[str],
    fmt: str = "parquet",
    options: dict[str, dict] | None = None,
    rollup_dir: str | None = None,
    spark: SparkSession | None = None,
) -> dict[str, str]:
    """Recompute the named dashboards and publish a version of each. ``options`` holds extra keyword
    arguments per dashboard (e.g. ``{"deployers": {"chain": ..., "chains": (...)}}``); with ``rollup_dir`` the stored
    rollups and key sets there are refreshed and read. Returns result -> path."""
    written = {}
    for name in names:
        extra = dict((options or {}).get(name, {}))
        if rollup_dir:
            extra |= _stored(spark or SparkSession.active(), tables, rollup_dir, name, as_of, timeframe, extra)
        results = DASHBOARDS[name](tables, as_of, timeframe, **extra)
        for key, path in write_dashboard(results, f"{out_dir.rstrip('/')}/{name}", fmt).items():
            written[f"{name}.{key}"] = path
    return written


def checkpoint_location(spark: SparkSession, query_name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir is not set; the stream needs a shared checkpoint folder")
    return f"{root.rstrip('/')}/{query_name}"


def start_refresh(
    spark: SparkSession,
    transactions_path: str,
    tables_factory: Callable[[], Tables],
    out_dir: str,
    timeframe: Timeframe | str = Timeframe.WEEK,
    names: tuple[str, ...] = ("users", "bd", "economics"),
    interval: str = DEFAULT_INTERVAL,
    clock: Callable[[], dt.datetime] | None = None,
    available_now: bool = False,
    query_name: str = "ledgerlens_refresh",
    options: dict[str, dict] | None = None,
    rollup_dir: str | None = None,
) -> StreamingQuery:
    """Start the publishing stream. ``tables_factory`` builds a fresh registry per batch (a new registry lists the
    table folders again, so files that arrived since the last batch are read)."""
    arrivals = spark.readStream.schema(SCHEMAS["transactions"]).parquet(transactions_path).select("block_timestamp")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        publish(tables_factory(), clock() if clock else now(), out_dir, timeframe, list(names), options=options, rollup_dir=rollup_dir, spark=spark)

    writer = arrivals.writeStream.queryName(query_name).foreachBatch(on_batch).option("checkpointLocation", checkpoint_location(spark, query_name))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
