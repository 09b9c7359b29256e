"""Connected components of a large edge list by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the same key, so no neighbourhood is gathered in one place, and the state
between steps is cut by reliable checkpoints in the shared folder. No step adds edges, so the number of the first
ones says how many files a checkpoint needs; a session with many shuffle partitions would else write as many small files a step (and for
each file and its checksum, an executor on a local folder starts a process that sets its mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

FILE_EDGES = 1 << 18  # edges of a checkpoint file, on average at most


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; the component is the smallest node reached. Nulls are no nodes."""
    spark = edges.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    x, y = F.col(a), F.col(b)
    stars = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct().checkpoint()
    files = 1 + stars.count() // FILE_EDGES
    while True:
        # Large star: the larger neighbours of a node go to the smallest node of its neighbourhood.
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: the smaller neighbours of a node, and itself, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        stars = small.distinct().coalesce(files).checkpoint()
        # Done when every node but the centres of stars has one edge, and leads to a centre.
        ends = stars.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))))
        open_ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)")
        if open_ends.isEmpty():
            break
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().coalesce(files)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
