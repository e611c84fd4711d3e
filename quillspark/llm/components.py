"""Connected components of an edge table, by alternating star contractions.

Large-star links each node's larger neighbours to the least node it sees,
small-star does so for its smaller ones; both are a map-side combined minimum
and a join.  Rounds are written to the shared folder, where each replaces the
one before, and grow with the logarithm of the component size; only two sums of
each round reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import delete, written

_EDGES = "a bigint, b bigint"


def _linked(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").distinct()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return _linked(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _linked(moved.union(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the least node of its component.

    Self-loops and repeated edges do nothing; an empty table gives an empty table.
    """
    now, path = written(_linked(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))), name)
    seen = None
    while True:
        before = path
        now, path = written(_small(_large(now)), name)
        delete(edges.sparkSession, before)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == seen:
            break
        seen = tuple(row)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class Forest:
    """Union-find over places 0 .. n-1 with vectorised unions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            self.parent[x] = self.parent[up]
            x = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each place that isn't a root, and its root."""
        root = self.root(np.arange(len(self.parent)))
        rest = np.flatnonzero(root != np.arange(len(root)))
        return rest, root[rest]
