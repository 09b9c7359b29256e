"""Manifest of a fact table's files: which days a refresh has to read again.

The manifest holds (file, modification time, size, day) of every file a refresh has seen. A refresh lists the folder
(names, times and sizes only; no file is opened), and a day changed if a file that holds it is new, replaced or gone. Days come from the
partition folder; for a table without day folders from the time column of the new files alone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, modified timestamp, size long, day date"


def of_files(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """The manifest of the Parquet table at ``path``; ``day`` is null where the file has to be read for it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    day = F.col(partition).cast("date") if partition in found.columns else F.lit(None).cast("date")
    return found.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), day.alias("day"))


def row_digest(*columns: str) -> Column:
    """A row's part of its day's digest; parts add up."""
    return F.xxhash64(*columns).bitwiseAND(0xFFFFFFFF)


def of_rows(rows: DataFrame, ts: str, *columns: str) -> DataFrame:
    """The manifest of a table without files: a row per day with its number of rows and a digest of ``columns``, which are read in full."""
    return of_digests(rows.select(F.to_date(ts).alias("day"), F.lit(1).cast("long").alias("size"), row_digest(*columns).alias("digest")))


def of_digests(parts: DataFrame) -> DataFrame:
    """:func:`of_rows` from (day, size, digest) of groups of rows, as an aggregate of the table carries them along."""
    per_day = parts.groupBy("day").agg(F.sum("size").alias("size"), F.sum("digest").alias("_digest"))
    name = F.concat(F.lit("rows:"), F.coalesce(F.col("day").cast("string"), F.lit("")), F.lit(":"), F.col("_digest").cast("string"))
    return per_day.select(name.alias("file"), F.lit("2000-01-01").cast("timestamp").alias("modified"), "size", "day")


def compare(now: DataFrame, seen: DataFrame, ts: str) -> tuple[DataFrame, list[dt.date]]:
    """(the manifest ``now`` with all its days, days that changed since ``seen``). One row per changed day reaches the driver, and
    for a table without day folders the names of its new files."""
    keys = ["file", "modified", "size"]
    fresh = now.join(seen.select(*keys).distinct(), keys, "left_anti")
    held = now.select(*keys).distinct()
    kept, gone = seen.join(held, keys, "left_semi"), seen.join(held, keys, "left_anti")
    unread = [r.file for r in fresh.filter("day is null and not startswith(file, 'rows:')").select("file").distinct().collect()]
    if unread:
        days = now.sparkSession.read.parquet(*unread).select(_bare(F.col("_metadata.file_path")).alias("_bare"), F.to_date(ts).alias("day")).distinct()
        fresh = fresh.drop("day").withColumn("_bare", _bare(F.col("file"))).join(days, "_bare", "left").select(*keys, "day")
    changed = fresh.select("day").union(gone.select("day")).distinct()
    return kept.unionByName(fresh), [r[0] for r in changed.collect() if r[0] is not None]


def _bare(path):
    """A path without scheme, as readers write it in several forms (file:/x, file:///x)."""
    return F.regexp_replace(path, r"^[a-z0-9]+:/*", "/")
