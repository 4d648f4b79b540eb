"""Connected components by forests of parts and alternating large-star and small-star steps.

A part of bounded edges is first replaced by its components' edges to their least
nodes, in the task that reads it. Where the edges are more than one part, star steps
follow. Both replace edges by edges to the least known neighbour; the number of
rounds grows with the logarithm of the component size, not with its diameter.
Every round is written to the shared folder, so lineage stays short and a lost
executor repeats one round at most; the round before is then deleted. Nothing is
collected but numbers of edges and one that tells whether a round changed anything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import persist, release, small_batches

PART_EDGES = 1 << 18
"""Edges that a task holds at once."""


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of edges' components for nodes that are not their component's least, the root."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = places[: len(u)], places[len(u) :]
    label = np.arange(len(nodes))
    while True:
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        apart = high != low
        if not apart.any():
            break
        a, b = high[apart], low[apart]
        np.minimum.at(label, a, b)
        while not np.array_equal(up := label[label], label):
            label = up
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def forests(edges: DataFrame, parts: int, most: int = PART_EDGES) -> DataFrame:
    """Edges (u, v), v less than u, that join what ``edges`` join: forests of at most ``most`` edges of a part. Narrow."""
    small_batches(edges.sparkSession)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= most:
                held, n = [forest(*map(np.concatenate, zip(*held)))], 0
                n = len(held[0][0])
                if 2 * n > most:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["u", "v"])
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held)))], ["u", "v"])

    return edges.select("u", "v").coalesce(parts).mapInArrow(run, "u long, v long")


def _to_least(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the least v of each u."""
    least = edges.groupBy("u").agg(F.min("v").alias("__least"))
    return edges.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Connect each node's larger neighbours to the least node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _to_least(both).where(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.least("u", "__least").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the least of them."""
    linked = _to_least(edges)
    pairs = linked.select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("__least").alias("v"))
    return pairs.where(F.col("u") != F.col("v")).distinct()


def _replaced(edges: DataFrame, by: DataFrame) -> DataFrame:
    out = persist(by, "edges")
    release(edges)
    return out


def connected_components(edges: DataFrame, rounds: int = 100, part_edges: int = PART_EDGES) -> DataFrame:
    """(node, root) for every node that has an edge; root is the component's least node.

    ``edges`` has long columns u and v. Self-loops and repeats are harmless; no
    edges give no rows.
    """
    current = persist(edges.where(F.col("u") != F.col("v")).select("u", "v"), "edges")
    parts = -(-current.count() // part_edges)
    if parts:
        current = _replaced(current, forests(current, parts, part_edges))
    before = None
    for _ in range(rounds if parts > 1 else 0):
        # The sum of hashes is modular; together with the count it identifies the edge set.
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
        if now[0] <= part_edges:
            current = _replaced(current, forests(current, 1, part_edges))
            break
        current = _replaced(current, small_star(large_star(current)))
    else:
        if parts > 1:
            raise RuntimeError(f"components did not settle within {rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
