"""Connected components of edges that are spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.tables import written

#: Nodes that a task joins in memory before it passes on what it has.
HELD = 1_000_000


class Forest:
    """What edges connect, each node with a smaller one above it; at most HELD nodes and a batch."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x: int) -> int:
        up = self.up
        while (above := up[x]) != x:
            up[x] = up[above]
            x = above
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """A batch of edges: joined in arrays first, so that only one edge for each of its nodes is left."""
        up = self.up
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j, low = at[: len(a)], at[len(a) :], np.arange(len(nodes))
        while len(i):
            x, y = low[i], low[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            smaller = np.minimum(x, y)
            np.minimum.at(low, x, smaller)
            np.minimum.at(low, y, smaller)
            while ((above := low[low]) != low).any():
                low = above
        for x, y in zip(nodes.tolist(), nodes[low].tolist()):
            x, y = self.root(up.setdefault(x, x) if x not in up else x), self.root(up.setdefault(y, y) if y not in up else y)
            up[max(x, y)] = min(x, y)

    @property
    def full(self) -> bool:
        return len(self.up) > HELD

    def passed(self) -> tuple[pa.Array, pa.Array]:
        """(nodes, their smallest ones) of all that are not their own; then it is empty."""
        found = [(x, r) for x in self.up if (r := self.root(x)) != x]
        self.up = {}
        return pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())


def _joined_locally(edges: DataFrame) -> DataFrame:
    """Edges to the smallest node of what a task's edges connect: at most one for each node of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        passed = lambda: pa.RecordBatch.from_arrays(list(forest.passed()), names=["a", "b"])
        for batch in batches:
            forest.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            if forest.full:
                yield passed()
        yield passed()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) of edges (a, b: whole numbers): the smallest node that each one reaches, for all that are not their own root.

    Each task first joins what it holds. Then every node's neighbours are joined to its smallest one: the
    larger neighbours, next the smaller ones, by turns, until each node has one smaller neighbour that has none.
    """
    now = written(_joined_locally(edges.where("a <> b")).distinct())
    for _ in range(rounds):
        parents = now.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if now.join(parents.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and parents.where("n > 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        larger = written(both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        lowest = written(larger.groupBy("a").agg(F.min("b").alias("m")))
        rest = larger.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(_joined_locally(rest.unionByName(lowest.select("a", F.col("m").alias("b")))).distinct())
    raise RuntimeError("the components did not settle")
