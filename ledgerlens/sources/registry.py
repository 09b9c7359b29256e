"""Table registry: logical table name -> DataFrame.

Metrics never name storage. They receive a :class:`Tables` registry and read logical tables from it, so the same
metric runs over Parquet folders, catalog tables or test fixtures. ``tables.as_of(ts)`` returns a registry whose fact
tables are cut at ``event_time <= ts``; the cut is a plain filter that Catalyst pushes into each scan.

Fact tables stored with a date partition column (``PARTITION_COLUMNS``) are also pruned by partition: the cut and
the time window a metric declares with ``tables.window(since, until)`` become filters on that column, which Spark
turns into ``PartitionFilters`` (files outside the window are never listed or opened). Catalyst cannot derive those
from timestamp predicates by itself. The exact timestamp predicates are still applied by the metric.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..timeframe import as_datetime, ntz
from .payloads import read_payloads
from .schemas import EVENT_TIME, PARTITION_COLUMNS, SCHEMAS, UNIQUE_KEYS, conform

Factory = Callable[[], DataFrame]


class Tables(Mapping):
    """Lazily built logical tables. Each factory runs at most once per registry."""

    def __init__(
        self,
        factories: Mapping[str, Factory | DataFrame],
        as_of: dt.datetime | None = None,
        since: dt.datetime | None = None,
        until: dt.datetime | None = None,
        window_names: tuple[str, ...] | None = None,
        _sources: dict[str, DataFrame] | None = None,
        paths: Mapping[str, str] | None = None,
    ):
        self._factories = dict(factories)
        # Source DataFrames, shared with every registry derived by ``as_of`` / ``window`` (a file source is listed
        # once per registry family, not once per metric).
        self._sources = _sources if _sources is not None else {}
        self._built: dict[str, DataFrame] = {}
        self.as_of_ts = as_of
        self.since_ts = since
        self.until_ts = until
        self.window_names = window_names
        #: Folders of the tables that are Parquet folders.
        self.paths = dict(paths or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name not in self._factories:
                raise KeyError(f"table {name!r} is not registered; known: {sorted(self._factories)}")
            if name not in self._sources:
                source = self._factories[name]
                self._sources[name] = source if isinstance(source, DataFrame) else source()
            df = self._prune_partitions(name, self._sources[name])
            if name in SCHEMAS:
                df = conform(name, df)
            if self.as_of_ts is not None and name in EVENT_TIME:
                df = df.filter(F.col(EVENT_TIME[name]) <= ntz(self.as_of_ts))
            self._built[name] = df
        return self._built[name]

    def _prune_partitions(self, name: str, df: DataFrame) -> DataFrame:
        part = PARTITION_COLUMNS.get(name)
        if part is None or part not in df.columns:
            return df
        windowed = self.window_names is None or name in self.window_names
        upper = [ts for ts in (self.as_of_ts, self.until_ts if windowed else None) if ts is not None]
        if upper:
            df = df.filter(F.col(part) <= F.lit(min(upper).date()))
        if windowed and self.since_ts is not None:
            df = df.filter(F.col(part) >= F.lit(self.since_ts.date()))
        return df

    def __iter__(self):
        return iter(self._factories)

    def __len__(self) -> int:
        return len(self._factories)

    def as_of(self, ts: dt.datetime | str) -> "Tables":
        """Registry with every fact table cut at ``event_time <= ts``."""
        return Tables(self._factories, as_of_ts_from(ts), self.since_ts, self.until_ts, self.window_names, self._sources, self.paths)

    def window(self, since=None, until=None, names: tuple[str, ...] | None = None) -> "Tables":
        """Registry that reads only the date partitions of ``[since, until]`` of the fact tables ``names`` (all fact
        tables when None). A pruning hint: rows are not cut to the exact timestamps, the metric does that."""
        lo = as_of_ts_from(since) if since is not None else None
        hi = as_of_ts_from(until) if until is not None else None
        return Tables(self._factories, self.as_of_ts, lo, hi, tuple(names) if names else None, self._sources, self.paths)

    def with_tables(self, **frames: Factory | DataFrame) -> "Tables":
        merged = dict(self._factories)
        merged.update(frames)
        kept = {name: path for name, path in self.paths.items() if name not in frames}
        return Tables(merged, self.as_of_ts, self.since_ts, self.until_ts, self.window_names, paths=kept)

    def validated(self, names: list[str] | None = None) -> "Tables":
        """This registry, after a check that the declared keys of ``names`` (all) are unique: the loading step."""
        assert_unique(self, names)
        return self

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, names: list[str] | None = None) -> "Tables":
        """Read ``{root}/{name}`` (a Parquet file or folder, partitioned or not) for every logical table."""
        wanted = names or list(SCHEMAS)

        def reader(name: str) -> Factory:
            return lambda: spark.read.parquet(f"{root.rstrip('/')}/{name}")

        return cls({name: reader(name) for name in wanted}, paths={name: f"{root.rstrip('/')}/{name}" for name in wanted})

    def with_payload_folder(self, spark: SparkSession, folder: str) -> "Tables":
        """This registry with the protocol payloads read from a folder of one JSON document per slug."""
        return self.with_tables(protocol_tvl=lambda: read_payloads(spark, folder))

    @classmethod
    def from_catalog(cls, spark: SparkSession, prefix: str, names: list[str] | None = None) -> "Tables":
        """Read ``{prefix}.{name}`` through ``spark.table`` (catalog tables keep their partition pruning)."""
        wanted = names or list(SCHEMAS)

        def reader(name: str) -> Factory:
            return lambda: spark.table(f"{prefix}.{name}")

        return cls({name: reader(name) for name in wanted})


def as_of_ts_from(ts: dt.datetime | str) -> dt.datetime:
    return as_datetime(ts)


def duplicate_keys(tables: Tables, name: str) -> DataFrame:
    """Rows of the declared unique key of ``name`` that occur more than once (empty when the table is clean)."""
    keys = UNIQUE_KEYS[name]
    return tables[name].groupBy(*keys).count().filter(F.col("count") > 1)


def assert_unique(tables: Tables, names: list[str] | None = None, sample: int = 5) -> None:
    """Raise if a declared unique key has duplicates (they would multiply sums in the joins that use them: labels
    in the leaderboard, prices in the revenue series). One aggregate per table; only a few offending keys reach the
    driver. An action, so callers run it when tables are loaded or refreshed, not per metric."""
    problems = []
    for name in names or list(UNIQUE_KEYS):
        if name in tables:
            bad = duplicate_keys(tables, name).limit(sample).collect()
            if bad:
                problems.append(f"{name}: duplicate {UNIQUE_KEYS[name]} e.g. {[tuple(r)[:-1] for r in bad]}")
    if problems:
        raise ValueError("; ".join(problems))
