"""Versioned day-partitioned tables with atomic commits.

A state is a folder of Parquet tables ``{table}/version=V``, rows sorted by their day ``block_date``. A refresh writes the days it rebuilds under
a new version, then a commit that says which version of each table and day is in force, and last of all the commit's name. Readers
take the last published commit, so they see all of a refresh or nothing, also while one runs or after one failed. Filters on
``block_date`` prune row groups.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_PART = dt.date(2000, 1, 1)  # tables not kept by day have numbered parts in place of days, counted from this date


class Commit:
    """What is in force: ``live[table][day]`` is a version; ``facts`` holds named numbers and texts."""

    def __init__(self, live: dict[str, dict[dt.date, str]], facts: dict[str, str]) -> None:
        self.live, self.facts = live, facts


class Versions:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]) -> None:
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def latest(self) -> Commit:
        """The last published commit (an empty one before the first). One row per table and live day reaches the driver."""
        try:
            names = [r[0] for r in self.spark.read.schema("version string").parquet(f"{self.root}/published").collect()]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            names = []
        commit = Commit({t: {} for t in self.schemas}, {})
        if names:
            for r in self.spark.read.parquet(f"{self.root}/commits/{max(names)}").collect():
                if r.kind == "fact":
                    commit.facts[r.name] = r.value
                else:
                    commit.live[r.name][r.day] = r.value
        return commit

    def new_version(self) -> str:
        return f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"

    def scratch(self, name: str) -> str:
        """A new folder beside the state for what one refresh reads several times."""
        return f"{self.root}/staging/{self.new_version()}/{name}"

    def write(self, table: str, version: str, df: DataFrame, dealt: bool = False) -> set[dt.date]:
        """Write ``df`` as a version, sorted by ``block_date``; returns the days it has. Rows ``dealt`` evenly by the aggregate that made
        them stay in its partitions: each file is sorted by day, and a day has no task of its own that would grow with it."""
        path = f"{self.root}/{table}/version={version}"
        ranged = df if dealt else df.repartitionByRange("block_date", *df.columns[:1])
        ranged.sortWithinPartitions("block_date").write.parquet(path)
        return {r[0] for r in self.spark.read.schema(f"{self.schemas[table]}, block_date date").parquet(path).select("block_date").distinct().collect()}

    def add_part(self, table: str, version: str, df: DataFrame, parts: dict[dt.date, str]) -> None:
        """Write ``df`` as one more part of a table that is not kept by day."""
        df.write.parquet(f"{self.root}/{table}/version={version}")
        parts[FIRST_PART + dt.timedelta(days=len(parts))] = version

    def read_parts(self, table: str, parts: dict[dt.date, str]) -> DataFrame:
        paths = [f"{self.root}/{table}/version={v}" for v in parts.values()]
        return self.spark.read.schema(self.schemas[table]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[table])

    def read(self, table: str, commit: Commit) -> DataFrame:
        """The table as the commit has it: its columns and ``block_date``."""
        live = commit.live[table]
        schema = f"{self.schemas[table]}, block_date date"
        if not live:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, version string").parquet(f"{self.root}/{table}").filter(F.col("version").isin(sorted(set(live.values()))))
        if len(set(live.values())) == 1:
            return rows.drop("version")  # a version holds no other days than the live ones while it is the only one
        key = F.concat_ws("/", "version", F.date_format("block_date", "yyyy-MM-dd"))
        return rows.filter(key.isin([f"{version}/{day.isoformat()}" for day, version in live.items()])).drop("version")

    def publish(self, version: str, commit: Commit) -> None:
        rows = [("fact", name, None, str(value)) for name, value in commit.facts.items()]
        rows += [("day", table, day, v) for table, days in commit.live.items() for day, v in days.items()]
        self.spark.createDataFrame(rows, "kind string, name string, day date, value string").coalesce(1).write.parquet(f"{self.root}/commits/{version}")
        self.spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{self.root}/published")
