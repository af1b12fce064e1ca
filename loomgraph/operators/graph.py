"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node near it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least(down)
    out = down.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an undirected edge table; a component is named by its least node.

    Large-star and small-star steps alternate until the edges are stars around
    the least nodes.  Only aggregations with partial sums and equi-joins are
    used; no neighbourhood is gathered into one row, so a node may have any
    degree.  Edges with a null end are ignored, loops and repeated edges do no
    harm, and a node with loops only is its own component.  Each round is
    written to the checkpoint folder.
    """
    edges = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    loops = edges.where("u = v").select(F.col("u").alias("node")).distinct()
    now = checkpointed(edges.where("u != v").distinct())
    mark = None
    for _ in range(rounds):
        now = checkpointed(_small_star(_large_star(now)))
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    linked = stars.unionByName(centres)
    return linked.unionByName(loops.join(linked, "node", "left_anti").select("node", F.col("node").alias("component")))
