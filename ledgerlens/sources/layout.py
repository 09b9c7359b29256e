"""Storage layout for fact tables: one folder per day, rows sorted by event time within files.

Writing a fact table with :func:`write_fact_table` adds its date partition column (``PARTITION_COLUMNS``), so the
registry can prune partitions by the metric windows, and sorts rows by event time inside each task so Parquet
row-group statistics prune within a day as well. Rows are not shuffled by date: a day holding a third of all rows
is written by all tasks in parallel (one file per task and day, capped by ``max_records_per_file``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schemas import EVENT_TIME, PARTITION_COLUMNS, conform


def with_partition_column(name: str, df: DataFrame) -> DataFrame:
    return conform(name, df).withColumn(PARTITION_COLUMNS[name], F.to_date(EVENT_TIME[name]))


def write_fact_table(name: str, df: DataFrame, path: str, mode: str = "overwrite", max_records_per_file: int = 5_000_000) -> None:
    part = PARTITION_COLUMNS[name]
    (
        with_partition_column(name, df)
        .sortWithinPartitions(part, EVENT_TIME[name])
        .write.mode(mode)
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(part)
        .parquet(path)
    )
