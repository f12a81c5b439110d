"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a hashed order, are cut into blocks of equal size. The ideal is a fluid: at any moment the
sources that still have something share the sequence in proportion to their weights, so when v is what a unit of weight
has got, T(v) = sum of min(blocks, weight * v) slots have passed. Block k (from 0) of a source of weight w is released at
slot floor(T(k / w)) and due at slot ceil(T((k + 1) / w)); every slot takes the released block that is due first. The
fluid itself meets these windows, so earliest deadline first on one sequence does, and each source's blocks deviate
from the fluid by less than one at every slot, from the first to the last, also after sources have run out. Weights
are the target weights themselves, as exact fractions, and all blocks are dealt one by one (on the driver, 24 bytes a
block). No document is dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import materialize, sized

#: Least characters of a block, and the number of blocks (apart from one a lane) beyond which it grows.
BLOCK, MOST_BLOCKS = 1 << 16, 1 << 20
#: Sources with a lane of their own, lanes of the others, rows of a source that are put in order by one task (on average).
LANES, GROUPS, BUCKET_ROWS = 2048, 256, 1024


def shares(weights: np.ndarray, period: int) -> np.ndarray:
    """Positive integers in proportion to the weights, with the period as sum (largest remainders)."""
    if len(weights) > period:
        raise ValueError("the period is shorter than the number of sources")
    exact = weights / weights.sum() * period
    out = np.maximum(1, np.floor(exact)).astype(np.int64)
    order = np.argsort(-(exact - out), kind="stable")
    i = 0
    while out.sum() < period:
        out[order[i % len(order)]] += 1
        i += 1
    while out.sum() > period:
        able = np.flatnonzero(out > 1)
        out[able[np.argmax((out - exact)[able])]] -= 1
    return out


def windows(a: list[int], blocks: list[int]) -> tuple[list[list[int]], list[list[int]]]:
    """(release, due) of every block of each source, from integer weights: T between two ends of sources is done + rest * v, in whole numbers."""
    by_end = sorted(range(len(a)), key=lambda i: Fraction(blocks[i], a[i]))
    done, rest = [0], [sum(a)]
    for i in by_end:
        done.append(done[-1] + blocks[i])
        rest.append(rest[-1] - a[i])
    release, due = [], []
    for w, n in zip(a, blocks):
        phase, floors, ceilings = 0, [], []
        for k in range(n + 1):
            while phase < len(by_end) and blocks[by_end[phase]] * w < k * a[by_end[phase]]:
                phase += 1
            floors.append(done[phase] + k * rest[phase] // w)
            ceilings.append(done[phase] - (k * rest[phase] // -w))
        release.append(floors[:-1])
        due.append(ceilings[1:])
    return release, due


def deal(a: list[int], release: list[list[int]], due: list[list[int]]) -> list[list[int]]:
    """The slot of every block: earliest deadline first among released blocks; of equal ones the heavier source."""
    slots: list[list[int]] = [[] for _ in a]
    waiting: dict[int, list[int]] = {}
    for i, r in enumerate(release):
        if r:
            waiting.setdefault(r[0], []).append(i)
    ready: list[tuple[int, int, int]] = []
    for t in range(sum(map(len, release))):
        for i in waiting.pop(t, ()):
            heapq.heappush(ready, (due[i][len(slots[i])], -a[i], i))
        end, _, i = heapq.heappop(ready)
        if end <= t:
            raise AssertionError("a deadline was missed")
        slots[i].append(t)
        k = len(slots[i])
        if k < len(release[i]):
            waiting.setdefault(max(release[i][k], t + 1), []).append(i)
    return slots


def one_period(a: np.ndarray) -> list[np.ndarray]:
    """The slots of one period of sum(a) slots that each source gets."""
    return [np.array(s, np.int64) for s in deal(a.tolist(), *windows(a.tolist(), a.tolist()))]


@dataclass
class Schedule:
    """slot, release and due of all blocks, source after source; ``begins`` has each source's first."""

    slot: np.ndarray
    release: np.ndarray
    due: np.ndarray
    begins: np.ndarray
    blocks: np.ndarray

    def place(self, source: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, release, deadline) of a source's blocks; a block is due before its deadline slot."""
        at = self.begins[source] + block
        return self.slot[at], self.release[at], self.due[at]


def whole_numbers(weights: np.ndarray) -> list[int]:
    """Integers in exactly the proportions of the weights."""
    exact = [Fraction(w) for w in weights.tolist()]
    scale = max((x.denominator for x in exact), default=1)  # powers of two
    return [int(x * scale) for x in exact]


def schedule(blocks: np.ndarray, weights: np.ndarray) -> Schedule:
    """Places every source's blocks. Sources of weight zero start when the others have run out, then in proportion to their sizes."""
    sizes, target, begin = blocks.astype(np.int64).tolist(), whole_numbers(weights), 0
    begins = np.cumsum(blocks) - blocks if len(blocks) else np.zeros(0, np.int64)
    slot, release, due = (np.zeros(int(sum(sizes)), np.int64) for _ in range(3))
    for weighted in (True, False):
        active = [i for i, n in enumerate(sizes) if n and bool(target[i]) == weighted]
        a = [target[i] if weighted else sizes[i] for i in active]
        opened, closed = windows(a, [sizes[i] for i in active])
        for i, own, first, last in zip(active, deal(a, opened, closed), opened, closed):
            here = slice(int(begins[i]), int(begins[i]) + sizes[i])
            for column, values in ((slot, own), (release, first), (due, last)):
                column[here] = np.array(values, np.int64) + begin
        begin += sum(sizes[i] for i in active)
    return Schedule(slot, release, due, begins, blocks)


OUT = ("mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_at")


def _lanes(totals: DataFrame, lanes: int, groups: int) -> DataFrame:
    """``totals`` with the lane of each source: its own for the heaviest, a hashed one for the others (of their own kind without weight)."""
    top = [r["mix_source"] for r in totals.orderBy(F.desc("weight"), F.col("s")).limit(lanes).select("mix_source").collect()]
    own = totals.sparkSession.createDataFrame(list(zip(top, range(len(top)))), "mix_source long, own long")
    shared = lanes + F.pmod(F.xxhash64("s"), F.lit(groups)) + F.when(F.col("weight") > 0, 0).otherwise(groups)
    return totals.join(F.broadcast(own), "mix_source", "left").withColumn("lane", F.coalesce("own", shared)).drop("own")


def _inside(block: int):
    """Sources of a lane to their blocks' places in it: how many characters of the lane stand before each block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(sorted(range(table.num_rows), key=lambda i: (table["s"][i].as_py() is None, str(table["s"][i].as_py())))))
        number, size, weight = (table[c].to_numpy() for c in ("mix_source", "size", "weight"))
        blocks = -(size // -block)
        slot = schedule(blocks, weight).slot if len(blocks) > 1 else np.arange(blocks.sum())
        of = np.repeat(np.arange(len(blocks)), blocks)
        k = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        order = np.argsort(slot)
        long = np.minimum(block, size[of] - block * k)[order]
        begin = np.empty(len(of), np.int64)
        begin[order] = np.cumsum(long) - long
        lane = np.full(len(of), table["lane"][0].as_py(), np.int64)
        return pa.table({"lane": lane, "mix_source": number[of], "mix_block": k, "begin": begin})

    return run


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = 0.7, block: int | None = None, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", lanes: int = LANES, groups: int = GROUPS) -> DataFrame:
    """``docs`` with mix_source (number), mix_block, mix_slot, mix_release, mix_deadline and mix_at (order within the slot).

    Read in the order (mix_slot, mix_at) the documents follow the target weights. ``weights`` gives them by
    source; without it they are the sources' sizes to the power ``alpha``. A source that ``weights`` lacks, or
    that has weight zero, follows after the others. ``size`` measures a document (characters of its text, at
    least 1). A null source is a source of its own; rows that repeat an id are documents of their own; an empty
    table stays empty. A document longer than a block takes the blocks it spans. Columns of ``docs``
    with one of these names give way to the new ones.
    """
    docs = docs.drop(*OUT, *[c for c in docs.columns if c.startswith("__mix_")])
    spark, order, kind = docs.sparkSession, "__mix_hash", docs.schema[source_col].dataType.simpleString()
    amount = F.greatest(F.coalesce(size if size is not None else F.length(text_col), F.lit(0)), F.lit(1)).cast("long")
    rows = docs.withColumn("__mix_size", amount)
    sums = rows.groupBy(F.col(source_col).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("__mix_size").alias("size"))
    if weights is None:
        sums = sums.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(alpha))))
    else:
        targets = spark.createDataFrame([(x, max(0.0, float(w))) for x, w in weights.items()], f"t {kind}, weight double")
        sums = sums.join(targets, F.col("s").eqNullSafe(F.col("t")), "left").drop("t").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    cells_of = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS)).cast("long")
    totals = materialize(sums.select("s", "size", "weight", cells_of.alias("cells"), F.monotonically_increasing_id().alias("mix_source")), "mix-sources")
    n_sources, whole, n_cells = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("cells"), F.lit(0))).first()
    block = block or max(BLOCK, -(whole // -MOST_BLOCKS))
    laned = _lanes(totals, lanes, groups)
    per_lane = sorted(tuple(r) for r in laned.groupBy("lane").agg(F.sum("size"), F.sum("weight")).collect())
    number, sizes, target = (np.array([r[k] for r in per_lane], t) for k, t in ((0, np.int64), (1, np.int64), (2, np.float64)))
    plan = schedule(-(sizes // -block), target)
    ends = np.cumsum(plan.blocks) if len(number) else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_numpy()
            lane = np.searchsorted(ends, at, "right")
            out = (number[lane], at - (ends - plan.blocks)[lane], plan.slot[at], plan.release[at], plan.due[at])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["lane", "lane_block", "mix_slot", "mix_release", "mix_deadline"])

    n_slots = int(plan.blocks.sum())
    slots = spark.range(n_slots).mapInArrow(place, "lane long, lane_block long, mix_slot long, mix_release long, mix_deadline long")
    inside = laned.select("lane", "s", "mix_source", "size", "weight").groupBy("lane").applyInArrow(_inside(block), "lane long, mix_source long, mix_block long, begin long")
    inside = inside.select("lane", "mix_source", "mix_block", F.floor(F.col("begin") / block).alias("lane_block"), (F.col("begin") % block).alias("__mix_from"))
    blocks = materialize(inside.join(sized(slots, n_slots, 64), ["lane", "lane_block"]).drop("lane", "lane_block"), "mix-blocks")

    numbers = totals.select(F.col("s").alias("__mix_s"), "mix_source", F.col("cells").alias("__mix_n"))
    keyed = rows.join(sized(numbers, n_sources, 128), F.col(source_col).eqNullSafe(F.col("__mix_s"))).withColumn(order, F.xxhash64(F.col(id_col), F.lit("mix")))
    # Even cells of the hashed order: their sums are few, and within a cell one task sorts about BUCKET_ROWS rows.
    keyed = keyed.withColumn("__mix_cell", F.floor((F.shiftrightunsigned(order, 33) / float(1 << 31)) * F.col("__mix_n")))
    ranked = keyed.join(sized(_bases(keyed), n_cells, 64), ["mix_source", "__mix_cell"])
    within = Window.partitionBy("mix_source", "__mix_cell").orderBy(order, id_col, "__mix_size")
    ranked = ranked.withColumn("__mix_begin", F.col("__mix_base") + F.sum("__mix_size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__mix_size"))
    ranked = ranked.withColumn("mix_block", F.floor(F.col("__mix_begin") / block))
    out = ranked.join(sized(blocks, n_slots + n_sources, 64), ["mix_source", "mix_block"]).withColumn("mix_at", F.col("__mix_from") + F.col("__mix_begin") % block)
    return out.select(*docs.columns, *OUT)


def _bases(keyed: DataFrame) -> DataFrame:
    """(mix_source, __mix_cell, __mix_base): characters of a source before each of its cells; sums of cells, then of runs of BUCKET_ROWS cells."""
    cells = keyed.groupBy("mix_source", "__mix_cell").agg(F.sum("__mix_size").alias("own")).withColumn("run", F.floor(F.col("__mix_cell") / BUCKET_ROWS))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inner = cells.withColumn("inner", F.coalesce(F.sum("own").over(before("mix_source", "run", "__mix_cell")), F.lit(0)))
    runs = cells.groupBy("mix_source", "run").agg(F.sum("own").alias("own")).select("mix_source", "run", F.coalesce(F.sum("own").over(before("mix_source", "run")), F.lit(0)).alias("outer"))
    return inner.join(runs, ["mix_source", "run"]).select("mix_source", "__mix_cell", (F.col("inner") + F.col("outer")).alias("__mix_base"))


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in the mix's order: files and rows follow (slot, place in the block); columns stay as they are."""
    aside = {c: f"__aside_{c}" for c in docs.columns if c.startswith(("mix_", "__mix_"))}
    mixed = mix(docs.withColumnsRenamed(aside), **options)
    ordered = mixed.repartitionByRange("mix_slot", "mix_at").sortWithinPartitions("mix_slot", "mix_at")
    return ordered.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
