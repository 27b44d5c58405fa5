"""Connected components of a graph of links between long ids, on executors only.

Each partition first contracts its edges to a forest with a vectorised union-find; large-star and small-star
rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014) then join the forests.
Every round is checkpointed in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.llm.shared import cut, map_arrow

#: Nodes that one task holds before it hands its forest on; later rounds join what is split.
HELD = 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest connected node) for each node of the edges that isn't its own root."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(nodes))
    while len(u):
        pu, pv = parent[u], parent[v]
        open_ = pu != pv
        u, v, pu, pv = u[open_], v[open_], pu[open_], pv[open_]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


class Forest:
    """Collects edges in bounded memory."""

    def __init__(self):
        self.a, self.b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_new = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            self.new.append((a, b))
            self.n_new += len(a)
        if self.n_new > 500_000:
            self._fold()
            if len(self.a) > HELD:
                yield from self.rest()

    def _fold(self) -> None:
        if self.new:
            self.a, self.b = forest(np.concatenate([self.a, *(x for x, _ in self.new)]), np.concatenate([self.b, *(y for _, y in self.new)]))
            self.new, self.n_new = [], 0

    def rest(self) -> Iterator[pa.RecordBatch]:
        self._fold()
        if len(self.a):
            yield pa.RecordBatch.from_arrays([pa.array(self.a, pa.int64()), pa.array(self.b, pa.int64())], ["a", "b"])
        self.a, self.b = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _contract(batches):
    held = Forest()
    for x in batches:
        yield from held.add(x["a"].to_numpy(zero_copy_only=False), x["b"].to_numpy(zero_copy_only=False))
    yield from held.rest()


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``edges(a, b)``; component is the smallest id reachable.

    Self-loops and repeated edges change nothing; an empty graph gives no rows; null ends are ignored.
    """
    e = map_arrow(edges.select("a", "b").where("a <> b"), _contract, "a long, b long")
    e = cut(e.distinct())
    while True:
        # A forest of stars: each child has one parent, and no parent is a child.
        state = e.agg(F.count("*").alias("n"), F.countDistinct("a").alias("children")).first()
        if state["n"] == state["children"] and e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are cut, so that both sides of their joins are plain shuffles, which Spark splits where a node has many neighbours.
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        e = cut(small.select("e.a", "e.b").where("a <> b").distinct())
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
