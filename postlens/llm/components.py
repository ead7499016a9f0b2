"""Connected components by alternating large-star and small-star steps.

Edges ``(a, b)`` are rewired towards the smallest node around them until every edge
leads from a node to the smallest of its component.  A step is one aggregation and one
join by node; a node with very many edges is pre-aggregated before the shuffle, and its
side of the join can be split.  Edges are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: neighbours above a node are tied to its smallest neighbour (or itself).
    Small: a node and its neighbours below are tied to the smallest of them."""
    ways = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")),
                   F.struct(F.col("b").alias("node"), F.col("a").alias("near")))
    near = edges.select(F.inline(ways))
    if not large:
        near = near.where("near < node")
    least = near.groupBy("node").agg(F.min("near").alias("least")).select("node", F.least("node", "least").alias("least"))
    tied = near.join(least, "node")
    if large:
        tied = tied.where("near > node").select(F.col("least").alias("a"), F.col("near").alias("b"))
    else:
        own = least.select(F.col("least").alias("a"), F.col("node").alias("b"))
        tied = tied.select(F.col("least").alias("a"), F.col("near").alias("b")).unionByName(own)
    return tied.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)`` with long nodes; the
    component is its smallest node.  Loops and repeated edges are ignored, and so are
    edges with NULL."""
    state = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    state = cut_lineage(state.where("a < b").distinct(), "edges")
    before = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        state = cut_lineage(_star(cut_lineage(_star(state, True), "edges"), False), "edges")
    roots = state.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return state.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
