"""Connected components by alternating star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketpulse.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is moved to the node's least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written first, so that the join's sides are plain shuffles and a hub's edges can be split
    least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the least one."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``edges`` (u, v: long) -> (node, root) for every node of an edge whose
    root differs from itself; ``root`` is the least node reachable.

    Each round is one large-star and one small-star step (a map-side combined
    minimum and a join each, so a hub is never gathered in one task) and is
    written to the shared folder.  Rounds grow with the logarithm of the
    longest chain.  No rows: no components.  Raises if ``max_rounds`` do not
    settle the graph, rather than return unfinished labels.
    """
    stamp = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1000003).alias("s"),
             F.bit_xor(F.xxhash64("u", "v")).alias("x")]
    edges = saved(_small_star(saved(edges)))
    seen = edges.agg(*stamp).first()
    for _ in range(max_rounds if seen["n"] else 0):
        edges = saved(_small_star(saved(_large_star(edges))))
        now = edges.agg(*stamp).first()
        if now == seen:
            break
        seen = now
    else:
        if seen["n"]:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
