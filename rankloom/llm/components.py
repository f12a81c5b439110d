"""Connected components of a distributed edge list by alternating large-star and small-star rounds.

Each round is a minimum per node (combined on the map side) and a join back, so no neighbourhood is ever
gathered. Both go by salted cells of a node's edges: a hub with a third of all edges is dealt over SALTS keys.
Tables between rounds are written to the shared folder. Edges are first contracted to a forest inside each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import materialize

#: Cells over which the edges of one node are dealt.
SALTS = 128


class Forest:
    """Union-find over arbitrary integers; the root of a set is its smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        """Each member with the root of its set."""
        members = list(self.parent)
        return members, [self.find(x) for x in members]

    def add_pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            self.union(x, y)


def forest_batch(forest: Forest) -> Iterator[pa.RecordBatch]:
    a, b = forest.edges()
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        forest.add_pairs(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        if len(forest.parent) > 2_000_000:  # bounded memory: hand on what is known and start anew
            yield from forest_batch(forest)
            forest = Forest()
    yield from forest_batch(forest)


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def with_least(rows: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with m, the least ``value`` of their key's rows, and (key, m) of all keys; a key's rows are joined cell by cell."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    cells = salted.groupBy(key, "salt").agg(F.min(value).alias("low"))
    least = cells.groupBy(key).agg(F.min("low").alias("m"))
    return salted.join(cells.select(key, "salt").join(least, key), [key, "salt"]).drop("salt"), least


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long). Returns node, component (its smallest node) for every node of an edge that has a smaller one.

    Edges with a null end, loops and repeated edges link nothing more; an empty table gives an empty result.
    """
    links = materialize(edges.where("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long"), "links")
    stamp = _stamp(links)
    while stamp[0]:
        both, _ = with_least(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))), "a", "b")
        large = both.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        known, least = with_least(large, "a", "b")
        small = known.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        links = materialize(small, "links")
        before, stamp = stamp, _stamp(links)
        if stamp == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
