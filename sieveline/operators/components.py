"""Connected components of nodes of any ordered type, by stars.

Edges point from a node to a smaller one. In a round every node first hands its larger
neighbours to the least node around it, then itself and its smaller neighbours; both keep
components together and pull them towards their least node, so the rounds grow with the
logarithm of a component's size, whatever its shape. A node that very many others link to
is a heavy key of a join with one row for each node, which adaptive execution splits.

A round is written to the folder that the cluster shares and the one before is deleted;
what the driver sees are a count and a sum of hashes that tell whether anything changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.storage import release, stored


def handed(edges: DataFrame) -> DataFrame:
    """Edges (node, near) with ``least``, the least of a node and its neighbours."""
    around = edges.groupBy("node").agg(F.min("near").alias("least"))
    return edges.join(around, "node").withColumn("least", F.least("node", "least"))


def contracted(edges: DataFrame) -> DataFrame:
    """One round over distinct edges (node, near) with near < node."""
    both = edges.unionByName(edges.select(F.col("near").alias("node"), F.col("node").alias("near")))
    large = handed(both).where("near > node").select(F.col("near").alias("node"), F.col("least").alias("near")).distinct()
    small = handed(large)
    ends = F.explode(F.array("node", "near")).alias("node")
    return small.select(ends, F.col("least").alias("near")).where("node <> near").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node that is reachable, for every node of the edges (u, v).

    Repeated edges and edges from a node to itself are harmless; no edges give no rows.
    """
    edges = stored(edges.select("u", "v").distinct())
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("near")).distinct())
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("node", "near").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            break
        before, now, seen = now, stored(contracted(now)), state
        release(before)
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    roots = now.select(F.col("near").alias("node")).distinct()
    found = now.select("node", F.col("near").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    alone = edges.where("u = v").select(F.col("u").alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))
