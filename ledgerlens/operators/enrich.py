"""Attach a value read from a keyed JSON payload (e.g. a protocol's locked value on one chain) to result rows.

The payload table is joined like any dimension (broadcast when Spark's size check allows, else sort-merge); rows with
no payload, a NULL key, or no number at the path get NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich_json(df: DataFrame, payloads: DataFrame, key: str, path: str, out: str, payload_col: str = "payload") -> DataFrame:
    values = payloads.select(F.col(key).alias("_key"), F.get_json_object(payload_col, path).try_cast("double").alias(out))
    return df.join(values, df[key] == F.col("_key"), "left").drop("_key")
