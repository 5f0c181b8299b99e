"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each round is one minimum per node, which combines before the shuffle, and one join on the node; no node's
neighbours are ever gathered. Every round's edges go to the shared checkpoint folder, so that lineage stays
short and a lost executor costs one round at most. (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star operation over edges (u, v)."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = both.join(least, "u")
    if large:  # neighbours above u point to the least neighbour
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v")).where("u <> v")).distinct()


def _mark(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (u, v), whose ids are any ordered numbers; component is the least node.

    Nodes without edges do not occur. Nulls and loops are ignored; repeated edges count once; no edges give no rows.
    """
    pairs = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = settled(pairs)
    mark = _mark(pairs)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        larger = settled(_star(pairs, True))
        pairs = settled(_star(larger, False))
        now = _mark(pairs)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
