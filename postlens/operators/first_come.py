"""Greedy first-come selection over conflicts, resolved in parallel rounds.

The sequential rule "keep a row unless it conflicts with an earlier kept row" is
evaluated without listing conflicting pairs.  Conflicts are given as shared edges:
two rows conflict when they meet on an edge and at least one of them is a member
of it.  A round needs one aggregation per edge and one per row, so its cost is
linear in the incidences however many rows meet on one edge.

Plain rounds decide the earliest of what waits, so a chain of n rows, each in conflict
with the one before, would need n of them.  After ``PLAIN_ROUNDS`` the rounds follow
chains: a row with a single earlier rival has the opposite fate of that rival, and such
pointers are doubled until they end, so a chain costs log n joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage
from .skew import HOT_ROWS, lookup_join

#: Rounds before chains are followed; most inputs need no more.
PLAIN_ROUNDS = 2


def first_come(incidence: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Kept rows of ``incidence(edge, node, ord, member)`` as one column ``node``.

    ``ord`` is the arrival order, unique per node.  In a round, a waiting row is
    dropped if an earlier kept row conflicts with it, and kept if no earlier row
    that is kept or waiting does; a later round also decides all rows that hang on
    such a row by single rivals.  The earliest waiting row is always decided.  Edges
    without waiting rows leave the loop.
    """
    rows = cut_lineage(incidence.withColumn("kept", F.lit(False)), "conflicts")
    # Rounds only take rows away, so that crowded edges are looked for once.
    crowded = not rows.groupBy("edge").count().where(F.col("count") > hot_rows).isEmpty()
    results = []
    rounds = 0
    while not rows.where(~F.col("kept")).isEmpty():
        decide = _round if rounds < PLAIN_ROUNDS else _chain_round
        after = cut_lineage(decide(rows, hot_rows if crowded else None), "conflicts")
        results.append(after.where("kept").select("node"))
        rows = after.where("waits").drop("waits")
        rounds += 1
    if not results:
        return rows.select("node")
    return reduce(DataFrame.unionByName, results).distinct()


def _with_edges(rows: DataFrame, values: dict[str, Column], hot_rows: int | None) -> DataFrame:
    """``rows`` with the aggregated ``values`` of their edge.

    Where no edge is crowded, which ``hot_rows`` None tells, a window has them in one shuffle."""
    if hot_rows is None:
        edge = Window.partitionBy("edge")
        return rows.select("*", *[value.over(edge).alias(name) for name, value in values.items()])
    edges = rows.groupBy("edge").agg(*[value.alias(name) for name, value in values.items()])
    return lookup_join(rows, edges, ["edge"], hot_rows)


def _firsts() -> dict[str, Column]:
    """Of an edge: its first row and member, and its first kept ones."""
    member, kept, order = F.col("member"), F.col("kept"), F.col("ord")
    return {
        "first_any": F.min(order), "first_member": F.min(F.when(member, order)),
        "kept_any": F.min(F.when(kept, order)), "kept_member": F.min(F.when(member & kept, order)),
    }


def _round(rows: DataFrame, hot_rows: int | None) -> DataFrame:
    member, order, node = F.col("member"), F.col("ord"), Window.partitionBy("node")
    edges = _with_edges(rows, _firsts() | {"waits": F.max(~F.col("kept"))}, hot_rows)
    # A member conflicts with every row on the edge, others with members only.
    rival = F.when(member, F.col("first_any")).otherwise(F.col("first_member"))
    kept_rival = F.when(member, F.col("kept_any")).otherwise(F.col("kept_member"))
    met = edges.select(
        "edge", "node", "ord", "member", "waits",
        F.coalesce(rival < order, F.lit(False)).alias("blocked"),
        F.coalesce(kept_rival < order, F.lit(False)).alias("dropped"),
    )
    # A row meets few edges.
    fate = met.select(
        "edge", "node", "ord", "member", "waits",
        F.max("dropped").over(node).alias("dropped"), (~F.max("blocked").over(node)).alias("kept"),
    )
    return fate.where(~F.col("dropped")).select("edge", "node", "ord", "member", "kept", "waits")


def _chain_round(rows: DataFrame, hot_rows: int | None) -> DataFrame:
    """A round that follows single rivals; columns as of :func:`_round`."""
    member, kept, order = F.col("member"), F.col("kept"), F.col("ord")
    met = _with_edges(rows, _firsts(), hot_rows)
    if hot_rows is not None:
        met = cut_lineage(met, "met")  # read twice below
    second = {
        "second_any": F.min(F.when(order > F.col("first_any"), order)),
        "second_member": F.min(F.when(member & (order > F.col("first_member")), order)),
        "waits": F.max(~kept),
    }
    rival = F.when(member, F.col("first_any")).otherwise(F.col("first_member"))
    other = F.when(member, F.col("second_any")).otherwise(F.col("second_member"))
    kept_rival = F.when(member, F.col("kept_any")).otherwise(F.col("kept_member"))
    met = cut_lineage(
        _with_edges(met, second, hot_rows).select(
            "edge", "node", "ord", "member", "waits",
            F.when(rival < order, rival).alias("rival"),
            F.coalesce(other < order, F.lit(False)).alias("several"),
            F.coalesce(kept_rival < order, F.lit(False)).alias("dropped"),
        ),
        "met",
    )
    rivals = F.max("several") | F.coalesce(F.min("rival") < F.max("rival"), F.lit(False))
    nodes = cut_lineage(
        met.groupBy("node", "ord").agg(
            F.max("dropped").alias("dropped"), F.min("rival").alias("rival"), rivals.alias("several")
        ),
        "rivals",
    )
    # Rows without a rival enter, those of a kept rival do not; others may lead to such a row.
    known = nodes.where("dropped OR rival IS NULL").select("node", "ord", (~F.col("dropped")).alias("enters"))
    ends = _chain_ends(nodes.where("NOT dropped AND NOT several AND rival IS NOT NULL"))
    told = ends.join(known.select(F.col("ord").alias("end"), "enters"), "end").select(
        "node", (F.col("enters") != F.col("odd")).alias("enters")
    )
    fates = known.select("node", "enters").unionByName(told)
    return (
        met.drop("rival", "several", "dropped")
        .join(fates, "node", "left")
        .where(F.coalesce("enters", F.lit(True)))
        .select("edge", "node", "ord", "member", F.col("enters").isNotNull().alias("kept"), "waits")
    )


def _chain_ends(single: DataFrame) -> DataFrame:
    """``(node, end, odd)``: where the rivals of ``single(node, ord, rival)`` lead to, and
    whether in an odd number of steps.  Each pass doubles the steps that a pointer spans."""
    state = cut_lineage(
        single.select("node", "ord", F.col("rival").alias("end"), F.lit(True).alias("odd")), "chains"
    )
    while True:
        ahead = state.select(
            F.col("ord").alias("end"), F.col("end").alias("next"), F.col("odd").alias("more")
        )
        moved = F.col("next").isNotNull()
        state = cut_lineage(
            state.join(ahead, "end", "left").select(
                "node", "ord", F.coalesce("next", "end").alias("end"),
                F.when(moved, F.col("odd") != F.col("more")).otherwise(F.col("odd")).alias("odd"),
                moved.alias("moved"),
            ),
            "chains",
        )
        if state.where("moved").isEmpty():
            return state.select("node", "end", "odd")
        state = state.drop("moved")
