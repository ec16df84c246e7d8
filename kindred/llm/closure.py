"""Connected components of an edge table, by hooking and contraction.

Every round each node hooks to its smallest neighbour, pointers are shortened until they reach a
local minimum, and edges are rewritten between those. At least half of the remaining nodes of every
unfinished component vanish per round, so rounds grow with the logarithm of the nodes. All tables stay
distributed; a hub's edges are combined on the map side before they meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node."""
    current = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not current.isEmpty():
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")))
        while True:  # shorten
            up = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
            shorter = cut_lineage(hooks.join(up, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            hooks = shorter.select("node", "to")
            if shorter.where("moved").isEmpty():
                break
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("component"))
        else:
            moved = labels.join(hooks.select(F.col("node").alias("component"), "to"), "component", "left")
            labels = cut_lineage(moved.select("node", F.coalesce("to", "component").alias("component")))
        left = hooks.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        right = hooks.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        met = current.join(left, "a").join(right, "b").where("ra <> rb")
        current = cut_lineage(met.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if labels is None:
        labels = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
