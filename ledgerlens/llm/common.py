"""Helpers the operators share: table reading, Arrow column appending, shared scratch tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that does not clash with one of ``df`` (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(offset, length) runs of a binary column of about ``most`` bytes each; a longer value is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if k > at and held + size > most:
            yield at, k - at
            at, held = k, 0
        held += int(size)
    if len(sizes) > at:
        yield at, len(sizes) - at


#: Rows and bytes of an Arrow batch at most (a longer row is a batch of its own): a batch lies in the JVM and in the Python worker at once.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes where they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def append_struct(df: DataFrame, text_col: str, fn: Callable[[list], pa.StructArray], schema: T.StructType, into: str, slice_bytes: int = 4 << 20) -> DataFrame:
    """Append struct column ``into`` computed from ``text_col`` by Arrow batches; all other columns pass through.

    ``fn`` gets texts as a list of ``bytes | None``, about ``slice_bytes`` at a time, and returns a struct array of the
    same length.
    """
    small_batches(df.sparkSession)
    source = fresh_name(df, "_utf8")
    out_schema = T.StructType([*df.schema.fields, T.StructField(into, schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            for at, length in slices(batch.column(n), slice_bytes):
                part = batch.slice(at, length)
                made = fn(part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], made], names=[*batch.schema.names[:n], into])

    return df.withColumn(source, F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, out_schema)


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a scratch folder only for a local session without it (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="llm-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _OWN[app]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written, not when the driver happens to collect its garbage.

    A setting of the session that Spark 4.1 knows; an older one keeps the files as before.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(spark: SparkSession, df: DataFrame, name: str, *, partition_by: tuple[str, ...] = (), rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def sha256_hex(col) -> F.Column:
    return F.sha2(col.cast("binary"), 256)
