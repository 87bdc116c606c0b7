"""Connected components of an edge table, by alternating large and small stars.

Each round rewrites the edges so that every node points at ever smaller nodes of its
component; the number of rounds grows with the logarithm of the longest path. A round
is two minimum aggregations (combined before the shuffle) and two equi joins whose
large sides Spark may split, so a node with a third of all edges is no bottleneck.
Only the edge count and one checksum reach the driver. What is left of a graph after the
first contractions is often small: below ``SMALL`` edges a round runs in few tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialize

#: Graphs of at most this many edges are dealt to one task for each ``PART`` of them.
SMALL, PART = 1_000_000, 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that an edge names; component: the smallest node reachable.

    Nodes are of any orderable type. Edges with a null end count for nothing, loops
    name their node only, repeated edges count once; an empty table gives an empty one.
    The rounds go on until one changes nothing; each but the last moves some node to a
    smaller one, so they end, and nothing is raised.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = both.select(F.col("u").alias("node")).union(both.select("v")).distinct()
    few = lambda df, by: df.repartition(max(1, -(-state[0] // PART)), by) if state[0] <= SMALL else df
    now = materialize(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    settled = not state[0]
    while not settled:
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        way = few(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "u")
        low = way.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = few(way.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "u").distinct()
        # small star: every smaller neighbour of u, and u itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        now = materialize(few(small, "u").distinct(), "edges")
        before, state = state, _state(now)
        settled = state == before
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
