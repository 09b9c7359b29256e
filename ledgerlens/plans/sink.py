"""Publishing a dashboard: one folder per result, written by the executors (no collect on the driver).

Results go to a new version folder, and only when all of them are written is the version's name appended to the list of
published ones: a reader never sees a missing or half-written result. JSON lines reproduce the original response shape
(one record per row); Parquet is the default for downstream readers.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLISHED = "published"


def write_dashboard(results: dict, path: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every result of a dashboard to ``{path}/{version}/{key}`` and publish the version. Text (the time stamp)
    becomes a one-row result. Returns key -> folder."""
    if fmt not in ("parquet", "json"):
        raise ValueError("fmt must be parquet or json")
    root = path.rstrip("/")
    spark = next(df.sparkSession for df in results.values() if isinstance(df, DataFrame))
    version = f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    written = {}
    for key, result in results.items():
        df = result if isinstance(result, DataFrame) else spark.createDataFrame([(str(result),)], f"`{key}` string")
        written[key] = f"{root}/{version}/{key}"
        df.write.format(fmt).save(written[key])
    spark.createDataFrame([(version, fmt)], "version string, fmt string").write.mode("append").parquet(f"{root}/{PUBLISHED}")
    return written


def read_dashboard(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Result ``key`` of the latest published version."""
    root = path.rstrip("/")
    latest = spark.read.parquet(f"{root}/{PUBLISHED}").agg(F.max(F.struct("version", "fmt")).alias("v")).first()["v"]
    return spark.read.format(latest["fmt"]).load(f"{root}/{latest['version']}/{key}")
