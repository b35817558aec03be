"""Connected components of a distributed edge list.

Each round every node points to its least neighbour, pointers are followed a few steps
at once, and the edges are rewritten between the targets, so at least half of the nodes
that still have edges vanish per round and long chains shrink by a power of two. All
steps are equi-joins and aggregations with map-side combining; nothing is collected, and
a node with many edges is only ever a key whose rows are combined or whose join
partition Spark may split. Edges and labels are checkpointed each round in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def connected_components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """``edges`` has columns ``u`` and ``v`` (one type, orderable, no nulls). Returns ``node`` and ``root``
    (the least node reachable) for every node that has an edge to another one."""
    live = checkpoint(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("node"), F.least("u", "m").alias("to"))
        for _ in range(jumps):
            step = to.select(F.col("node").alias("to"), F.col("to").alias("far"))
            to = to.join(step, "to", "left").select("node", F.coalesce("far", "to").alias("to"))
        to = checkpoint(to)
        ends = {c: to.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("u", "v")}
        live = checkpoint(live.join(ends["u"], "u").join(ends["v"], "v").where(F.col("u_to") != F.col("v_to")).select(
            F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).distinct())
        if labels is None:
            labels = to.select("node", F.col("to").alias("root"))
        else:
            step = to.select(F.col("node").alias("root"), F.col("to").alias("far"))
            labels = checkpoint(labels.join(step, "root", "left").select(
                "node", F.coalesce("far", "root").alias("root")))
    if labels is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
