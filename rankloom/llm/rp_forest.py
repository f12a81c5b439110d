"""Embedding near-duplicates by a random-projection tree forest with spill overlap.

Each tree splits recursively at random directions; vectors between the two thresholds of a split go to both
sides. Directions come from seeds. The first levels' thresholds are fitted on a bounded sample, but every
vector is dealt into every tree. Leaves that are still too large are split on, in rounds over the cluster,
with thresholds from all their vectors; what can't be split (a dense family) is compared in pairs of blocks,
exactly. Pairs are compared within leaves in double precision, counted in the smallest leaf they share, and
each leaf hands on link counts and a spanning forest, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import materialize, sized
from rankloom.llm.components import Forest, connected_components, with_least

#: Vectors of the fitting sample; aimed leaf size; largest leaf that one task compares.
SAMPLE, LEAF, CAP = 8192, 1024, 4096
#: Quantiles of a node's projections between which it may be cut; steps of them, and least width, on either side of the cut that both children get.
GRID = [round(0.2 + 0.025 * k, 3) for k in range(25)]
SPILL_STEPS, SPILL_WIDTH = 2, 0.05
#: A node whose middle half is narrower than this holds a family of linked vectors and isn't cut.
DENSE = 0.35
#: Chance that a split keeps a pair at the threshold together, and the share of such pairs that may be missed.
KEEPS, MISSES = 0.88, 0.002
SALTS = 32


def n_trees(n: int, leaf: int = LEAF) -> int:
    """Trees so that a pair at the threshold meets in some leaf with a chance of 1 - MISSES."""
    depth = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
    together = min(KEEPS**depth, 0.999999)
    return max(1, math.ceil(math.log(MISSES) / math.log(1 - together)))


def direction(dim: int, *seed: int) -> np.ndarray:
    return np.random.default_rng([dim, *[s & 0xFFFFFFFFFFFFFFFF for s in seed]]).standard_normal(dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no under- or overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cut(grid: np.ndarray) -> tuple[float, float] | None:
    """Thresholds (low, high) at the sparsest place of a node's projections, given their quantiles at GRID; None for a dense node."""
    if grid[-3] - grid[2] < DENSE:
        return None
    gaps = np.diff(grid)[SPILL_STEPS:-SPILL_STEPS]
    # Of nearly equal gaps the middle one, so that children are of like size.
    weight = gaps * (1 - 0.3 * np.abs(np.linspace(-1, 1, len(gaps))))
    j = int(np.argmax(weight)) + SPILL_STEPS
    middle = (grid[j] + grid[j + 1]) / 2
    return float(min(grid[j - SPILL_STEPS + 1], middle - SPILL_WIDTH)), float(max(grid[j + SPILL_STEPS], middle + SPILL_WIDTH))


def fit_tree(sample: np.ndarray, tree: int, n: int, leaf: int) -> dict[int, tuple[float, float]]:
    """node -> thresholds (low, high); a node without them is a leaf."""
    out, todo = {}, [(1, np.arange(len(sample)))]
    while todo:
        node, own = todo.pop()
        if len(own) < 64 or n * len(own) / len(sample) <= leaf:
            continue
        p = sample[own] @ direction(sample.shape[1], tree, node)
        if (bounds := cut(np.quantile(p, GRID))) is None:
            continue
        out[node] = bounds
        for child, part in ((2 * node, p <= bounds[1]), (2 * node + 1, p >= bounds[0])):
            if part.sum() < 0.9 * len(own):
                todo.append((child, own[part]))
    return out


def _leaves(x: np.ndarray, tree: int, splits: dict) -> Iterator[tuple[int, np.ndarray]]:
    todo = [(1, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if node not in splits:
            yield node, own
            continue
        p, (low, high) = x[own] @ direction(x.shape[1], tree, node), splits[node]
        todo += [(2 * node, own[p <= high]), (2 * node + 1, own[p >= low])]


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) of a batch's embeddings."""
    column = batch.column("embedding")
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, values[begins[rows][:, None] + np.arange(dim)]


def _place(classes: DataFrame, n: int, leaf: int, trees: int) -> DataFrame:
    """(rep, leaf) rows of all classes, from trees fitted on the sample."""
    share = min(1.0, SAMPLE / max(n, 1))
    picked = classes.where(F.pmod(F.xxhash64("rep", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").limit(2 * SAMPLE).toPandas()
    samples: dict[int, list] = {}
    for v in picked["embedding"]:
        samples.setdefault(len(v), []).append(v)
    forest = {dim: [fit_tree(unit(np.array(v)), t, round(n * len(v) / len(picked)), leaf) for t in range(trees)] for dim, v in samples.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column("rep").to_numpy()
            for dim, rows, matrix in _by_dim(batch):
                x = unit(matrix)
                for t in range(trees):
                    for node, own in _leaves(x, t, forest[dim][t] if dim in forest else {}):
                        key = np.full(len(own), dim << 44 | t << 32 | node, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(reps[rows[own]]), pa.array(key)], names=["rep", "leaf"])

    return classes.select("rep", "embedding").mapInArrow(place, "rep long, leaf long")


def _split_round(placed: DataFrame, classes: DataFrame, large: DataFrame) -> DataFrame:
    """Deal the members of large leaves into up to eight children each, by three directions at once."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, out = batch.column("leaf").to_numpy(), np.zeros((batch.num_rows, 3))
            for dim, rows, matrix in _by_dim(batch):
                x = unit(matrix)
                for leaf in np.unique(leaves[rows]).tolist():
                    own = leaves[rows] == leaf
                    out[rows[own]] = x[own] @ np.stack([direction(dim, leaf, k) for k in range(3)], 1)
            yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("rep"), *[pa.array(out[:, k].copy()) for k in range(3)]], names=["leaf", "rep", "p0", "p1", "p2"])

    members = placed.join(large.select("leaf"), "leaf").join(classes.select("rep", "embedding"), "rep")
    seen = materialize(members.mapInArrow(project, "leaf long, rep long, p0 double, p1 double, p2 double"), "forest-projections")

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[cut(np.array(g)) or (-math.inf, -math.inf) for g in batch.column(f"g{k}").to_pylist()] for k in range(3)]  # undivided: all to the upper side
            yield pa.RecordBatch.from_arrays([batch.column("leaf"), *[pa.array([list(b) for b in f], pa.list_(pa.float64())) for f in found]], names=["leaf", "b0", "b1", "b2"])

    grids = seen.groupBy("leaf").agg(*[F.percentile_approx(f"p{k}", GRID, 1000).alias(f"g{k}") for k in range(3)])
    bounds = grids.mapInArrow(cuts, "leaf long, b0 array<double>, b1 array<double>, b2 array<double>")
    sides = [F.filter(F.array(F.when(F.col(f"p{k}") <= F.col(f"b{k}")[1], 2 * k), F.when(F.col(f"p{k}") >= F.col(f"b{k}")[0], 2 * k + 1)), lambda s: s.isNotNull()) for k in range(3)]
    dealt = seen.join(bounds, "leaf")
    for k, side in enumerate(sides):
        dealt = dealt.withColumn(f"s{k}", F.explode(side))
    return dealt.select("rep", F.xxhash64("leaf", "s0", "s1", "s2").alias("leaf"))


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leaf, x, y) to (rep, links) and (a, b) rows."""
    names = ["a", "b", "links"]

    def settle(group: pa.Table) -> Iterator[pa.RecordBatch]:
        group = group.combine_chunks()
        batch = group.to_batches()[0]
        rep, weight, blk = (batch.column(c).to_numpy() for c in ("rep", "weight", "blk"))
        leaf, x, y = (batch.column(c)[0].as_py() for c in ("leaf", "x", "y"))
        shared = batch.column("leaves")
        sizes = np.diff(shared.offsets.to_numpy())
        other = np.full((len(rep), max(1, int(sizes.max()))), np.iinfo(np.int64).max)  # leaves before this one
        other[np.arange(other.shape[1]) < sizes[:, None]] = shared.flatten().to_numpy()
        links, forest = np.zeros(len(rep), np.int64), Forest()
        for _, rows, matrix in _by_dim(batch):
            v = unit(matrix)
            left, right = (rows, rows) if x == y else (rows[blk[rows] == x], rows[blk[rows] == y])
            at = np.zeros(len(rep), np.int64)
            at[rows] = np.arange(len(rows))
            for i in range(0, len(left), 256):
                part = left[i : i + 256]
                a, b = np.nonzero(v[at[part]] @ v[at[right]].T >= least)
                a, b = part[a], right[b]
                if x == y:
                    a, b = a[a < b], b[a < b]
                for j in range(0, len(a), 1 << 14):
                    p, q = a[j : j + (1 << 14)], b[j : j + (1 << 14)]
                    # Seen elsewhere if a leaf before this one holds both.
                    mine = other[p][:, :, None]
                    seen = ((mine == other[q][:, None, :]) & (mine < leaf)).any((1, 2))
                    p, q = p[~seen], q[~seen]
                    np.add.at(links, p, weight[q])
                    np.add.at(links, q, weight[p])
                    forest.add_pairs(rep[p], rep[q])
        got = np.flatnonzero(links)
        if len(got):
            yield pa.RecordBatch.from_arrays([pa.array(rep[got]), pa.nulls(len(got), pa.int64()), pa.array(links[got])], names=names)
            a, b = forest.edges()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], names=names)

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = [held.column(c).to_numpy() for c in ("leaf", "x", "y")]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        begins = [0, *new.tolist()]
        for i, j in zip(begins, begins[1:]):
            yield from settle(held.slice(i, j - i))
        held = held.slice(begins[-1])
    if held is not None and held.num_rows:
        yield from settle(held)


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", leaf: int = LEAF, cap: int = CAP, trees: int | None = None) -> DataFrame:
    """Per vector: id, n_links (other vectors found with cosine >= least), component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, link
    with nothing. Vectors of different lengths don't link. Equal vectors form a class that is compared once
    and counts with its size. Rows that repeat an id are vectors of their own, whatever they hold: each counts
    and is linked by itself. An empty table gives an empty result; other columns are not read.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0) & F.col("id").isNotNull()
    salted = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
    good = rows.where(sound)
    cells = good.groupBy("embedding", salted).agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    # rep numbers the classes: an id doesn't, as rows of different vectors may share it.
    classes = materialize(cells.groupBy("embedding").agg(F.min("low").alias("low"), F.sum("n").alias("weight")).withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    trees = trees or n_trees(n, leaf)
    placed = materialize(_place(classes, n, leaf, trees), "forest-leaves")
    before = math.inf
    for _ in range(2 + max(0, math.ceil(math.log2(max(n, 1) / cap) / 2))):
        large = materialize(placed.groupBy("leaf").count().where(F.col("count") > cap), "forest-large")
        n_large, held = large.agg(F.count(F.lit(1)), F.sum("count")).first()
        if not n_large or held > 0.9 * before:  # what is left is dense
            break
        before = held
        few = sized(large, n_large, 32)
        children = _split_round(placed, classes, few)
        placed = materialize(placed.join(few, "leaf", "left_anti").select("rep", "leaf").union(children), "forest-leaves")
    own = placed.distinct()
    blocks = own.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / cap).alias("n_blocks")).where("n_blocks > 1")
    leaves = own.groupBy("rep").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    dealt = classes.join(leaves, "rep").withColumn("leaf", F.explode("leaves")).join(materialize(blocks, "forest-blocks"), "leaf", "left")
    dealt = dealt.withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1))).withColumn("blk", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("n_blocks")))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    dealt = dealt.select("leaf", F.least("blk", "k").alias("x"), F.greatest("blk", "k").alias("y"), "blk", "rep", "weight", "embedding", F.filter("leaves", lambda x: x < F.col("leaf")).alias("leaves"))
    dealt = dealt.repartition("leaf", "x", "y").sortWithinPartitions("leaf", "x", "y")
    found = materialize(dealt.mapInArrow(lambda batches: _compare(batches, least), "a long, b long, links long"), "vector-links")
    links = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    component = connected_components(found.where("b is not null").select("a", "b"))
    members = classes.select("rep", "low").join(component, F.col("rep") == F.col("node"), "left").select("rep", "low", F.coalesce("component", "rep").alias("component"))
    placed, _ = with_least(members, "component", "low")
    joined = classes.join(links, "rep", "left").join(placed.select("rep", "m"), "rep")
    per_class = joined.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("m").alias("component_id"))
    per_cell = cells.select("embedding", "salt").join(per_class, "embedding")
    linked = good.withColumn("salt", salted).join(per_cell, ["embedding", "salt"]).select("id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
