"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.plans.scratch import dropped, written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang neighbours on the least node that they see.  A star's centre is
    one row of ``least``, so a hub's edges can be split by a skewed join."""
    if small:
        near = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        out = near.join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst")).union(least.select("u", "m"))
    else:
        near = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src"))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = near.where("v > u").join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    return out.where("src <> dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of an edge with the least node it can
    reach.  ``edges`` has two columns of one orderable type; nulls, loops and
    repeated edges are ignored, an empty table gives an empty one.  O(log n)
    rounds, each linear in the edges and written to the shared folder."""
    a, b = edges.columns
    now = written(edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst").distinct())
    before = None
    while True:
        large = written(_star(now, small=False))
        new = written(_star(large, small=True))
        dropped(now, large)
        now = new
        # Distinct edges: their number and two sums of hashes tell whether any changed.
        hashes = [F.sum(F.xxhash64("src", "dst", F.lit(i)).cast("decimal(38,0)")) for i in (0, 1)]
        after = tuple(now.agg(F.count("*"), *hashes).head())
        if after == before or not after[0]:
            break
        before = after
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
