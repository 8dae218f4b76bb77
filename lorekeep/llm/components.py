"""Union-find: in memory for the links inside one task, and as a distributed job over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


class Forest:
    """Union-find by smallest member with path halving."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node reachable.

    Alternating star contraction: each round every node's greater neighbours are hung on its smallest
    neighbour, then its smaller ones. Rounds are few (logarithmic) and each is written to the
    checkpoint folder; the driver reads one count and one checksum a round. Nulls and self-loops are
    ignored; no edges give no rows. A hub is joined on its key, which adaptive execution splits.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    state = cut(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    seen = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        state = cut(small.distinct())
        mark = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    roots = state.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
