"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

MAX_ROUNDS = 100


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame) -> DataFrame:
    """Point every neighbour of a node, and the node itself, at the least node among them."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (u, v); component is the least node reachable.

    Large-star and small-star rounds: each halves the depth of the trees, needs two shuffles of
    the edges, and leaves at most as many edges as before. An edge table that doesn't change in a
    round is a set of stars. Loops and repeated edges are allowed, edges with a null end are left
    out, and no edges give no rows.
    """
    now = materialise(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark.n == 0 or (mark.n, mark.h) == seen:
            leaves = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
            return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = (mark.n, mark.h)
        large = _star(_directed(now)).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where(F.col("u") > F.col("v")).distinct()
        starred = _star(down)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))
        after = materialise(small.where(F.col("u") > F.col("v")).distinct(), "edges")
        discard(now)
        now = after
    raise RuntimeError(f"components haven't settled in {MAX_ROUNDS} rounds")
