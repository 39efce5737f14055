"""Connected components by contraction: no driver-side graph, no task that holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.session import cut_lineage


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``edges``; the component is its smallest node.

    Each round orders the nodes at random (by a hash seeded with the round), points every node at its first neighbour,
    follows the pointers (pointer jumping), moves the edges to the nodes reached and drops those that became loops. In a
    random order runs of pointers are short, so a round leaves a fraction of the nodes, and the rounds grow with the
    logarithm of the number of nodes, for long paths too. Null ends are ignored, loops give a component of one; an empty
    table gives an empty one. Both ends must have one sortable type.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    ends = cut_lineage(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    loops = ends.where("u = v").select(F.col("u").alias("at"), F.col("u").alias("to"))
    links, steps = ends.where("u <> v"), []
    while not links.isEmpty():
        if len(steps) >= max_rounds:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
        placed = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), F.col(c)).alias("place"), F.col(c).alias("id"))  # noqa: B023, E731
        both = links.union(links.select("v", "u"))
        points = both.groupBy("u").agg(F.min(placed("v")).alias("first"))
        points = points.select(F.col("u").alias("at"), F.least(placed("u"), F.col("first"))["id"].alias("to"))
        for _ in range(2):  # each jump doubles the distance followed
            next_hop = points.select(F.col("at").alias("to"), F.col("to").alias("further"))
            points = points.join(next_hop, "to", "left").select("at", F.coalesce("further", "to").alias("to"))
        points = cut_lineage(points)
        steps.append(points)
        moved = links.join(points.select(F.col("at").alias("u"), F.col("to").alias("u2")), "u").join(points.select(F.col("at").alias("v"), F.col("to").alias("v2")), "v")
        moved = moved.where("u2 <> v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct()
        links = cut_lineage(moved)
    # a node's way goes through the rounds; a loop counts only where its node has no other link
    labels = loops.join(steps[0], "at", "left_anti").union(steps[0]) if steps else loops
    for points in steps[1:]:
        further = points.select(F.col("at").alias("to"), F.col("to").alias("further"))
        labels = labels.join(further, "to", "left").select("at", F.coalesce("further", "to").alias("to"))
    labels = cut_lineage(labels)
    least = labels.groupBy("to").agg(F.min("at").alias("component"))
    return labels.join(least, "to").select(F.col("at").alias("node"), "component")
