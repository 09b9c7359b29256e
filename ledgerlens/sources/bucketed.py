"""Layout for joins on the target address: transactions and contracts bucketed alike, with hot targets spread when they are written.

``write_targets`` stores the transactions in catalog tables, by day partition and in buckets of ``target_key``, and the contracts in
the same number of buckets of ``address``. A join of the two on these columns then needs no shuffle on either side.

A bucket is one task of such a join, so an address with a large part of all rows must not lie in one. Addresses that make up more
than ``share`` of the rows of a write (counted once, with map-side combining; at most 1 / ``share`` of them), and rows without a
target, get a ``target_key`` made of the address and of a number from the row's hash: it matches no contract, and it spreads
them over all buckets. Whether these addresses are contracts is looked up in the small table of hot targets instead, which has at
most 1 / ``share`` rows a write. Results are the same whatever is hot.

Each write has its own tables (``{prefix}_hot_targets``, ``{prefix}_transactions``, ``{prefix}_contracts``, written in this order);
:func:`read_targets` opens them. A task of the join reads one bucket of every day, so choose ``buckets`` by the columns read: some
GB each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import bounded
from .schemas import EVENT_TIME, PARTITION_COLUMNS, conform

KEY = "target_key"
TX, CONTRACTS, HOT = "transactions", "contracts", "hot_targets"
#: A task of the write or of the join holds one bucket: about half a kB of memory a row.
ROWS_PER_BUCKET = 1_000_000


@dataclass(frozen=True)
class Targets:
    """The stored tables: ``transactions`` with ``target_key``, ``contracts`` and ``hot`` (column ``address``)."""

    transactions: DataFrame
    contracts: DataFrame
    hot: DataFrame


def target_counts(tx: DataFrame) -> DataFrame:
    """Rows per target, the missing one included: ``to_address, n``."""
    return tx.groupBy("to_address").agg(F.count(F.lit(1)).alias("n"))


def hot_targets(counts: DataFrame, rows: int, share: float) -> DataFrame:
    """The addresses with more than ``share`` of the ``rows``: ``address``; at most 1 / ``share`` rows."""
    return counts.where(F.col("to_address").isNotNull() & (F.col("n") > F.lit(rows * share))).select(F.col("to_address").alias("address"))


def _spread_key(spread: int) -> Column:
    """A key that no address has (it begins with a zero character) and that deals rows of one target over ``spread`` keys."""
    return F.concat(F.lit("\0"), F.coalesce("to_address", F.lit("")), F.lit("\0"), F.pmod(F.xxhash64("hash", "from_address", "block_timestamp"), F.lit(spread)).cast("string"))


def _options(df: DataFrame, root: str | None, name: str):
    writer = df.write.mode("overwrite").format("parquet")
    return writer.option("path", f"{root.rstrip('/')}/{name}") if root else writer


def write_targets(spark: SparkSession, transactions: DataFrame, contracts: DataFrame, prefix: str, buckets: int, share: float | None = None, root: str | None = None) -> Targets:
    """Store both tables in ``buckets`` buckets as catalog tables named ``{prefix}_..``, under ``root`` if given; in more where a
    bucket, which is one task, would hold over ``ROWS_PER_BUCKET`` rows on average.

    ``share`` (default a tenth of a bucket's even share) bounds what one address adds to one bucket. Rows are dealt to
    ``buckets`` tasks by their bucket before they are written, so each task writes one file a day and bucket.
    """
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    if share is not None and not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    tx = conform(TX, transactions)
    counts = target_counts(tx).persist(StorageLevel.DISK_ONLY)  # one row per target
    rows = counts.agg(F.sum("n")).first()[0] or 0
    buckets = max(buckets, -(-rows // ROWS_PER_BUCKET))
    share = share if share is not None else 0.1 / buckets
    _options(hot_targets(counts, rows, share), root, HOT).saveAsTable(f"{prefix}_{HOT}")
    counts.unpersist()
    hot = spark.table(f"{prefix}_{HOT}")
    marked = tx.join(bounded(hot.select(F.col("address").alias("_hot"))), F.col("to_address") == F.col("_hot"), "left")
    marked = marked.withColumn("_spread", F.col("to_address").isNull() | F.col("_hot").isNotNull()).drop("_hot")
    key = F.when(F.col("_spread"), _spread_key(16 * buckets)).otherwise(F.col("to_address"))
    part = PARTITION_COLUMNS[TX]
    # The key and the day are made of a row's other columns: the shuffle does without them.
    keyed = marked.repartition(buckets, key).withColumns({part: F.to_date(EVENT_TIME[TX]), KEY: key}).drop("_spread")
    dealt = keyed.sortWithinPartitions(part, KEY, EVENT_TIME[TX])
    _options(dealt, root, TX).partitionBy(part).bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(f"{prefix}_{TX}")
    known = conform(CONTRACTS, contracts).repartition(buckets, "address")
    _options(known, root, CONTRACTS).bucketBy(buckets, "address").sortBy("address").saveAsTable(f"{prefix}_{CONTRACTS}")
    return read_targets(spark, prefix)


def is_stored(spark: SparkSession, prefix: str) -> bool:
    """Whether all tables of ``prefix`` are written: the contracts are the last."""
    return spark.catalog.tableExists(f"{prefix}_{CONTRACTS}")


def read_targets(spark: SparkSession, prefix: str) -> Targets:
    return Targets(*(spark.table(f"{prefix}_{name}") for name in (TX, CONTRACTS, HOT)))
