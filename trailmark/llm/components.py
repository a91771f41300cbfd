"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import forget, new_path, stored


def settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that itself hangs on none."""
    ends = F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where("up > 1 or (up = 1 and down = 1)").head(1)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(u, v)`` with the smallest node it can reach.

    Returns ``node, component``, for nodes that have an edge to another node;
    loops and edges with a null end are ignored.  Every round only takes
    minima per node (combined before the shuffle) and joins them back, so a hub
    is an ordinary skewed join and no neighbour list is ever collected.
    Each round is written to the shared folder, and the table of the round before is deleted.
    """
    spark = edges.sparkSession
    hi, lo = F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")
    path = new_path(spark, "edges")
    now = stored(edges.where("u <> v").select(hi, lo).distinct(), path)
    for _ in range(max_rounds):
        if settled(now):
            break
        both = now.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionAll(
            now.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        )
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))))
        small = large.join(least, "hi").select(pairs.alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
        before, path = path, new_path(spark, "edges")
        now = stored(small, path)
        forget(spark, before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return leaves.unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
