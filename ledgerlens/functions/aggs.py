"""Aggregation helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tag_values(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """One row per input row and column: ``keys, _t`` (the column's position in ``columns``) and ``_v`` (its value
    as text). NULL values are dropped, as ``count(distinct)`` ignores them."""
    pairs = F.array(*[F.struct(F.lit(i).alias("t"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns.values())])
    tagged = df.select(*keys, F.explode(pairs).alias("_tv")).select(*keys, F.col("_tv.t").alias("_t"), F.col("_tv.v").alias("_v"))
    return tagged.filter(F.col("_v").isNotNull())


def count_tags(distinct_tagged: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Count distinct tagged values per group (``distinct_tagged`` holds distinct (keys, _t, _v) rows)."""
    return distinct_tagged.groupBy(*keys).agg(*[F.count_if(F.col("_t") == i).alias(n) for i, n in enumerate(names)])


def distinct_counts(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """``count(distinct col)`` per group for several columns, as an explicit two-level aggregate.

    Each row is tagged once per column (``explode`` of a small array), reduced to distinct (keys, tag, value) with a
    map-side partial aggregate, then counted per tag. This is the plan Catalyst builds for several distinct
    aggregates, written out so that its shape is fixed: identical uses of it canonicalize identically and share
    one shuffle.
    """
    return count_tags(tag_values(df, keys, columns).distinct(), keys, list(columns))
