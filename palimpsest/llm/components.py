"""Distributed union-find: connected components of an undirected graph of long ids.

Up to ``EDGES`` edges are one task's work, whatever the shape of the graph.
More edges are first cut down to forests, ``EDGES`` at a time, in parallel;
then alternating large and small stars run until nothing changes: every node's
larger neighbours are linked to its smallest one, then its smaller neighbours
and itself to the smallest of those. Every round is written to the shared
folder, so a lost executor costs one round's tasks at most. A hub with very many
neighbours is only met in map-side combined minima and in joins that adaptive
execution can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

#: Edges that one task holds (16 bytes each).
EDGES = 1_000_000


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of the graph with edges a - b; a root is the smallest node reached."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[root]
        low, high = np.minimum(rx, ry)[apart], np.maximum(rx, ry)[apart]
        np.minimum.at(root, high, low)
        while True:  # every node to its root's root
            up = root[root]
            if (up == root).all():
                break
            root = up


def _forest(batches):
    """Stars (hi, lo) that connect what a task's edges connect."""
    ends = [(common.column(x, "hi").to_numpy(), common.column(x, "lo").to_numpy()) for x in batches]
    if ends:
        nodes, roots = roots_of(np.concatenate([h for h, _ in ends]), np.concatenate([o for _, o in ends]))
        rest = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[rest]), pa.array(roots[rest])], names=["hi", "lo"])


def connected(edges: DataFrame, a: str = "a", b: str = "b", most: int = EDGES) -> DataFrame:
    """(node, root) for every node of an undirected edge; root is the smallest node it reaches.

    Edges with a null end and loops are ignored; repeated edges count once; no
    edges give an empty table.
    """
    now = common.save(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") > F.col("lo"))).distinct(),
        "edges",
    )
    n = now.count()
    if not n:
        return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    forest = common.save(now.repartition(-(-n // most)).mapInArrow(_forest, "hi bigint, lo bigint").distinct(), "edges")
    common.discard(now)
    now, state = forest, _fingerprint(forest)
    while n > most:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = common.save(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "large")
        large = common.save(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        floor = common.save(large.groupBy("hi").agg(F.min("lo").alias("m")), "small")
        small = large.join(floor, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = common.save(small.unionByName(floor.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        was, state = state, _fingerprint(after)
        for old in (now, least, large, floor):
            common.discard(old)
        now = after
        if state == was:
            break
    roots = now.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


class UnionFind:
    """Union-find over 0 .. n - 1 for the edges that one task sees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True
