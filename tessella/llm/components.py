"""Connected components of a distributed edge table, by contraction: no edge or label passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.llm.scratch import drop, written


def connected(edges: DataFrame) -> DataFrame:
    """(id, label) for each node of edges(a, b); label is the smallest id of the component.

    Each round points every node at its smallest neighbour, follows that pointer once more, and replaces nodes by what they
    point at. The number of nodes at least halves wherever an edge is left, so rounds grow with the logarithm of the longest
    path. No edges give an empty result; loops and repeated edges change nothing.
    """
    pairs = edges.select("a", "b").where("a <> b")
    left = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    maps: list[DataFrame] = []
    while not maps or not left.isEmpty():
        near = left.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("to"))
        far = near.select(F.col("id").alias("__id"), F.col("to").alias("__to"))
        to = written(near.join(far, near["to"] == far["__id"], "left").select("id", F.coalesce("__to", "to").alias("to")), "pointers")
        maps.append(to)
        of_a, of_b = (to.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        before, left = left, written(left.join(of_a, "a").join(of_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct(), "edges")
        drop(before)
    out = maps[0].select("id", F.col("to").alias("label"))
    for to in maps[1:]:
        far = to.select(F.col("id").alias("__id"), F.col("to").alias("__to"))
        out = out.join(far, out["label"] == far["__id"], "left").select("id", F.coalesce("__to", "label").alias("label"))
    out = written(out, "labels")
    drop(left, *maps)
    return out
