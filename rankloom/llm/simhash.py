"""SimHash near-duplicates, found by fuzzy hashing with the perfect binary Golay code.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. If two fingerprints differ in at most two
bits, some segment is equal and another one differs in at most one bit. A segment is keyed by the indices
of Golay codewords near it: its own codeword, and where that one is three bits away (the code's covering
radius) also the five codewords four bits away. Two segments at most one bit apart then share an index, so
the keys (equal segment, codeword index of the other) of the two fingerprints meet. Pairs that meet are
verified. Buckets of over BUCKET fingerprints, which only dense families of near-equal fingerprints fill,
are linked exactly without pairs: fingerprints at most two bits apart share a point at most one bit from each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import give_back, materialize, sized, without
from rankloom.llm.components import Forest, connected_components, forest_batch

#: Fixed value: generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)
BUCKET = 64
SALTS = 64
RADIUS = 2


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> np.uint32(bit) & np.uint32(1), rest ^ np.uint32(GENERATOR << (bit - 11)), rest)
    return rest


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: what to add to a word for its near codewords (own first), and how many there are."""
    info = np.arange(4096, dtype=np.uint32) << np.uint32(11)
    code = info | _syndromes(info)
    sevens = code[np.bitwise_count(code) == 7]
    add, n = np.zeros((2048, 6), np.uint32), np.ones(2048, np.int64)
    bits = [1 << i for i in range(23)]
    errors = [0] + bits + [a | b for i, a in enumerate(bits) for b in bits[:i]]
    threes = [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    for e, s in zip(errors + threes, _syndromes(np.array(errors + threes, np.uint32)).tolist()):
        add[s, 0] = e
        if e.bit_count() == 3:
            add[s, 1:] = np.uint32(e) ^ sevens[(sevens & np.uint32(e)) == e]
            n[s] = 6
    return add, n


_ADD, _NEAR = _tables()


def codeword_indices(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For an array of segments (up to 23 bits): which one each index is of, and the 12-bit indices."""
    syndrome = _syndromes(segments)
    n = _NEAR[syndrome]
    of = np.repeat(np.arange(len(segments)), n)
    which = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return of, (segments.astype(np.uint32)[of] ^ _ADD[syndrome[of], which]) >> np.uint32(11)


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of fingerprints: which fingerprint each key is of, and the keys."""
    parts = [((fingerprints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)) for shift, bits in SEGMENTS]
    of, out = [], []
    for b, fuzzy in enumerate(parts):
        who, index = codeword_indices(fuzzy)
        for a, equal in enumerate(parts):
            if a != b:
                of.append(who)
                out.append(np.uint64(3 * a + b << 34) | equal[who] << np.uint64(12) | index.astype(np.uint64))
    return np.concatenate(of), np.concatenate(out)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash: bit set if over half of the shingles' XXH64 (seed 42) have it; zero without words."""
    from xxhash import xxh64_digest

    w = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII space splits
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) > words else [b" ".join(w)]
    digests = b"".join([xxh64_digest(s, 42) for s in shingles])
    n, set_bits = len(digests) // 8, np.zeros(64, np.int64)
    for i in range(0, len(digests), 1 << 19):
        set_bits += np.unpackbits(np.frombuffer(digests[i : i + (1 << 19)], np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp of every document; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([fingerprint(t.as_py(), words) for t in part.column("text")], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            fp, rep = part.column("fp").to_numpy(), part.column("rep").to_numpy()
            of, key = keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[of]), pa.array(rep[of])], names=["key", "fp", "rep"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, fp, rep) rows to links (a, b), and members of large buckets as (null, fp, rep)."""
    forest = Forest()
    held = [np.empty(0, np.int64)] * 3  # the unfinished bucket, at most BUCKET + 1 rows of it
    spilled = None  # key of a large bucket that goes on

    def members(fp, rep):
        return pa.RecordBatch.from_arrays([pa.nulls(len(fp), pa.int64()), pa.nulls(len(fp), pa.int64()), pa.array(fp), pa.array(rep)], names=["a", "b", "fp", "rep"])

    def settle(key, fp, rep):
        for lag in range(1, BUCKET):
            same = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(same):
                return
            near = same[np.bitwise_count((fp[same] ^ fp[same + lag]).view(np.uint64)) <= RADIUS]
            forest.add_pairs(rep[near], rep[near + lag])

    for batch in batches:
        key, fp, rep = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "fp", "rep")))
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(begins, len(key)))
        large = (sizes > BUCKET) | (key[begins] == spilled) if spilled is not None else sizes > BUCKET
        row_large = np.repeat(large, sizes)
        if row_large.any():
            yield members(fp[row_large], rep[row_large])
        spilled = int(key[-1]) if large[-1] else None
        open_rows = np.zeros(len(key), bool)
        if not large[-1]:
            open_rows[begins[-1] :] = True
        done = ~row_large & ~open_rows
        settle(key[done], fp[done], rep[done])
        held = [x[open_rows] for x in (key, fp, rep)]
    settle(*held)
    a, b = forest.edges()
    for i in range(0, len(a), 65536):
        n = len(a[i : i + 65536])
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 65536], pa.int64()), pa.array(b[i : i + 65536], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["a", "b", "fp", "rep"])


def link_fingerprints(classes: DataFrame) -> DataFrame:
    """``classes``: distinct fp with its rep (long). Edges a, b between reps whose union links all fingerprints at most RADIUS bits apart."""
    met = classes.mapInArrow(_expand, "key long, fp long, rep long").repartition("key").sortWithinPartitions("key", "fp")
    found = materialize(met.mapInArrow(_verify, "a long, b long, fp long, rep long"), "simhash-links")
    edges = found.where("a is not null").select("a", "b")
    dense = found.where("a is null").select("fp", "rep").distinct()
    around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    points = dense.select(F.explode(around).alias("point"), "rep")
    hubs = points.groupBy("point").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "hub")
    return edges.union(points.join(hubs, "point").where("rep <> hub").select("rep", "hub").distinct())


def _salt():
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")


def _classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp, salt, low) per salted cell and (fp, rep) per distinct fingerprint, each with its smallest id."""
    cells = materialize(prints.groupBy("fp", _salt().alias("salt")).agg(F.min("doc_id").alias("low")), "fingerprint-cells")
    return cells, materialize(cells.groupBy("fp").agg(F.min("low").alias("rep")), "fingerprint-classes")


def simhash_groups(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, fingerprint (16 hex digits), component_id (smallest id reachable over links of at most two bits).

    Null, empty and blank texts have fingerprint zero and link like others. Rows that repeat an id are kept;
    null ids have a null component unless a copy or near copy has an id, and link nothing of their own. An
    empty table gives an empty result; other columns are not read.
    """
    prints = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    cells, classes = _classes(prints)
    component = connected_components(link_fingerprints(classes.where("rep is not null")))
    placed = classes.join(component, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    by_cell = cells.select("fp", "salt").join(placed, "fp")
    return prints.withColumn("salt", _salt()).join(by_cell, ["fp", "salt"]).select(
        F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Least shingle hashes by which a text meets others, and values of a text's sketch.
KEYS, SKETCH = 32, 96
#: Texts that share a hash up to which all pairs of them are compared; a hash that more texts hold is common.
COMMON = 16
#: Sketches this far below the limit still have their whole shingle sets compared (five standard errors).
MARGIN = 0.2
#: A text of which more than DENSE of the hashes are common is also compared with those that share one of its DENSE_KEYS
#: least common ones. Other texts need no common hash: at a similarity of 0.8 their other hashes are at least 0.56
#: similar, and all of 13 or more differ in about 0.44 ** 13 of cases.
DENSE, DENSE_KEYS = 0.6, 6
#: Most texts and bytes of hashes of a block (on average); bits of an odd sketch; standard errors around the limit
#: within which its estimate leaves a pair to the exact sets.
BLOCK, BLOCK_BYTES, ODD_BITS, ERRORS = 8192, 48 << 20, 2048, 4.5


def _digests(text: str | None, words: int) -> np.ndarray:
    """64-bit hashes of a text's shingles."""
    from xxhash import xxh64_digest

    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) > words else [b" ".join(w)]
    return np.frombuffer(b"".join([xxh64_digest(s, 42) for s in shingles]), ">u8").astype(np.uint64)


def parts_and_sketch(text: str | None, words: int = 5) -> tuple[list[int], bytes]:
    """A text's least shingle hashes, and the least 32-bit hashes of its shingles in order."""
    h = np.unique(_digests(text, words))
    return h[:KEYS].view(np.int64).tolist(), np.unique((h >> np.uint64(32)).astype("<u4"))[:SKETCH].tobytes()


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two texts' shingles from their sketches: exact below SKETCH shingles, else from the least SKETCH of both."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = np.union1d(x, y)
    if max(len(x), len(y)) == SKETCH:
        both = both[:SKETCH]
    return float(np.isin(both, np.intersect1d(x, y, assume_unique=True)).mean()) if len(both) else 1.0


def _sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                parts, sketches = zip(*[parts_and_sketch(t.as_py(), words) for t in part.column("text")])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(parts, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "parts", "sketch"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, parts array<long>, sketch binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part to pairs (a, b, null, null) of the texts of a part of up to COMMON, and rows (text, null, part, number of the text's parts) of larger ones."""
    held = [np.empty(0, np.int64)] * 3  # the unfinished part, at most COMMON rows of it
    spilled = None  # a large part that goes on

    def pairs(part, ids) -> pa.RecordBatch:
        low, high = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lag in range(1, COMMON):
            same = np.flatnonzero(part[lag:] == part[:-lag])
            if not len(same):
                break
            x, y = ids[same], ids[same + lag]
            low.append(np.minimum(x, y)[x != y])
            high.append(np.maximum(x, y)[x != y])
        both = np.unique(np.stack([np.concatenate(low), np.concatenate(high)]), axis=1)
        n = both.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["a", "b", "part", "of"])

    for batch in batches:
        part, ids, of = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("part", "doc_id", "of")))
        if not len(part):
            continue
        begins = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sizes = np.diff(np.append(begins, len(part)))
        large = (sizes > COMMON) | (part[begins] == spilled) if spilled is not None else sizes > COMMON
        rows = np.repeat(large, sizes)
        n = int(rows.sum())
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.nulls(n, pa.int64()), pa.array(part[rows]), pa.array(of[rows])], names=["a", "b", "part", "of"])
        spilled = int(part[-1]) if large[-1] else None
        open_rows = np.zeros(len(part), bool)
        if not large[-1]:
            open_rows[begins[-1] :] = True
        done = ~rows & ~open_rows
        yield pairs(part[done], ids[done])
        held = [x[open_rows] for x in (part, ids, of)]
    yield pairs(*held[:2])


def odd_sketches(hashes: np.ndarray) -> tuple[int, list[int], list[bytes]]:
    """(level, sizes, sketches) of a set of hashes at its level and the next: bits that tell whether an odd number of the members fall on each place.

    Of two sets, the bits that differ estimate how many members only one of them has. A level keeps a 2 ** level-th
    of the hashes, so that about ODD_BITS of them are left; sets whose levels are two apart are far from similar.
    """
    level = max(0, (len(hashes) // ODD_BITS).bit_length())
    sizes, out = [], []
    for at in (level, level + 1):
        own = hashes[(hashes >> np.uint64(11)) & np.uint64((1 << at) - 1) == 0]
        sizes.append(len(own))
        odd = np.bincount((own & np.uint64(ODD_BITS - 1)).astype(np.int64), minlength=ODD_BITS) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return level, sizes, out


def _odd_rows(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part, rows = batch.slice(i, 128), []
                for t in part.column("text"):
                    h = np.unique(_digests(t.as_py(), words))
                    level, (n0, n1), (b0, b1) = odd_sketches(h)
                    rows.append((len(h), level, n0, n1, b0, b1, h.tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=["doc_id", "n", "level", "n0", "n1", "odd0", "odd1", "hashes"])

    return texts.mapInArrow(run, "doc_id long, n long, level long, n0 long, n1 long, odd0 binary, odd1 binary, hashes binary")


class _Block:
    """Odd sketches of a group's rows, and which of them are known to be of one component."""

    def __init__(self, table: pa.Table):
        self.ids, self.n, self.level = (table.column(c).to_numpy() for c in ("doc_id", "n", "level"))
        self.sizes = [table.column(c).to_numpy() for c in ("n0", "n1")]
        self.odd = [np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64).reshape(len(self.ids), ODD_BITS // 64) for c in ("odd0", "odd1")]
        self.label = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        self.hashes = table.column("hashes").combine_chunks() if isinstance(table.column("hashes"), pa.ChunkedArray) else table.column("hashes")
        self.links: list[tuple[int, int]] = []
        self.degree = np.zeros(len(self.ids), np.int64)

    def estimates(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Similarity of a row with others, from what they don't share at the higher of their levels, and its standard error."""
        out, error = np.zeros(len(others)), np.zeros(len(others))
        for step in (-1, 0, 1):
            k = np.flatnonzero(self.level[others] == self.level[i] + step)
            if len(k):
                own, theirs = int(step > 0), int(step < 0)
                differ = np.bitwise_count(self.odd[own][i] ^ self.odd[theirs][others[k]]).sum(1, dtype=np.int64)
                apart = -ODD_BITS / 2 * np.log1p(-np.minimum(2 * differ / ODD_BITS, 0.999))
                both = self.sizes[own][i] + self.sizes[theirs][others[k]]
                all_ = np.maximum(both + apart, 1e-9)
                out[k] = (both - apart) / all_
                variance = (2 * both / all_**2) ** 2 * (2 * apart**2 / ODD_BITS + 0.25) * np.exp(np.minimum(4 * apart / ODD_BITS, 50))
                if self.level[i] + max(step, 0) > 0:  # a share of the hashes stands for all
                    variance += np.clip(out[k] * (1 - out[k]), 0, 1) * 2 / all_
                error[k] = np.sqrt(variance)
        return out, error

    def exact(self, i: int, j: int) -> float:
        """Similarity of two rows' whole sets."""
        x, y = (np.frombuffer(self.hashes[k].as_buffer(), np.uint64) for k in (i, j))
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared / max(1, len(x) + len(y) - shared)

    def compare(self, left: np.ndarray, right: np.ndarray, least: float) -> None:
        """Links between rows of the two sides, by ascending size so that few sizes are tried."""
        left, right = (x[np.argsort(self.n[x], kind="stable")] for x in (left, right))
        n = self.n[right]
        for i in left.tolist():
            a, b = np.searchsorted(n, [least * self.n[i] - 1e-6, self.n[i] / least + 1e-6])
            others = right[a:b]
            others = others[self.label[others] != self.label[i]]
            if not len(others):
                continue
            near, error = self.estimates(i, others)
            sure = others[near - ERRORS * error >= least]
            if len(sure):
                _, first = np.unique(self.label[sure], return_index=True)
                self.degree[i] += len(sure)
                self.degree[sure] += 1
                self.links += [(i, j) for j in sure[first].tolist()]
                self.label[np.isin(self.label, self.label[sure])] = self.label[i]
            open_ = np.flatnonzero(abs(near - least) < ERRORS * error)
            for j in others[open_[np.argsort(-near[open_], kind="stable")]].tolist():
                if self.label[i] != self.label[j] and self.exact(i, j) >= least:
                    self.degree[i] += 1
                    self.degree[j] += 1
                    self.links.append((i, j))
                    self.label[self.label == self.label[j]] = self.label[i]

    def rows(self, part: int) -> pa.Table:
        """(part, a, b, null) links that join components, fewer than there are rows, and (part, hub, null, links) for the row with the most."""
        a, b = np.array(self.links, np.int64).reshape(-1, 2).T
        hub = int(np.argmax(self.degree))
        return pa.table({"part": pa.array([part] * (len(a) + 1), pa.int64()), "a": pa.array([*self.ids[a].tolist(), int(self.ids[hub])], pa.int64()),
                         "b": pa.array([*self.ids[b].tolist(), None], pa.int64()), "degree": pa.array([None] * len(a) + [int(self.degree[hub])], pa.int64())})


_LINKS = "part long, a long, b long, degree long"


def _hub_links(least: float):
    """A block's texts held against the part's best-linked one, which comes as a row of its own (role 0)."""

    def run(table: pa.Table) -> pa.Table:
        own, role = _Block(table), table.column("role").to_numpy()
        hub = int(np.flatnonzero(role == 0)[0])
        others = np.flatnonzero((role == 1) & (own.ids != own.ids[hub]))
        near, error = own.estimates(hub, others)
        kept = [j for j in others[near + ERRORS * error >= least].tolist() if own.exact(hub, j) >= least]
        return pa.table({"a": own.ids[kept], "b": np.full(len(kept), own.ids[hub])})

    return run


def _inner_links(least: float):
    """A block's texts compared with one another."""

    def run(table: pa.Table) -> pa.Table:
        own = _Block(table)
        every = np.arange(len(own.ids))
        own.compare(every, every, least)
        return own.rows(table.column("part")[0].as_py())

    return run


def _outer_links(least: float):
    """A block's texts outside the part's largest component compared with a block of all."""

    def run(table: pa.Table) -> pa.Table:
        own, role = _Block(table), table.column("role").to_numpy()
        own.compare(np.flatnonzero(role == 0), np.flatnonzero(role == 1), least)
        return own.rows(table.column("part")[0].as_py())

    return run


def _dense_links(texts: DataFrame, members: DataFrame, links: DataFrame, least: float, words: int, block: int) -> DataFrame:
    """Links (a, b) between texts that consist of common shingles mostly.

    The texts of a common hash are compared block by block; where a hash has several blocks, all are then held
    against its best-linked text, and those that are still outside its largest component against all others.
    """
    own = members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("common"), F.max("of").alias("of"), F.slice(F.sort_array(F.collect_set("part")), 1, DENSE_KEYS).alias("parts"))
    dense = materialize(own.where(F.col("common") > DENSE * F.col("of")).select("doc_id", "parts"), "dense-texts")
    n_dense = dense.count()
    odd = materialize(_odd_rows(texts.join(sized(dense.select("doc_id"), n_dense, 64), "doc_id", "left_semi"), words), "odd-sketches")
    placed = materialize(dense.select("doc_id", F.explode("parts").alias("part")), "dense-parts")
    counted = placed.join(sized(odd.select("doc_id", "n"), n_dense, 64), "doc_id").groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("hashes")).where("size > 1")
    blocks = F.ceil(F.greatest(F.col("size") / block, 8 * F.col("hashes") / BLOCK_BYTES)).cast("long")
    sizes = materialize(counted.select("part", blocks.alias("blocks")), "dense-sizes")
    n_parts, most = sizes.agg(F.count(F.lit(1)), F.max("blocks")).first()
    blocked = placed.join(sized(sizes, n_parts, 64), "part").withColumn("block", F.pmod(F.xxhash64("doc_id", "part"), F.col("blocks")))
    whole = blocked.join(odd, "doc_id")
    found = materialize(whole.withColumn("component", F.col("doc_id")).groupBy("part", "block").applyInArrow(_inner_links(least), _LINKS), "dense-links")
    out = found.where("b is not null").select("a", "b")
    if (most or 0) <= 1:
        return out
    wide = whole.where("blocks > 1")
    hubs = found.groupBy("part").agg(F.max_by("a", "degree").alias("doc_id"))
    each = hubs.join(sized(sizes, n_parts, 64), "part").where("blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["part", "block", F.lit(0).alias("component"), *odd.columns]
    met = each.join(odd, "doc_id").select(F.lit(0).alias("role"), *columns).union(wide.select(F.lit(1).alias("role"), *columns))
    out = out.union(materialize(met.groupBy("part", "block").applyInArrow(_hub_links(least), "a long, b long"), "hub-links"))
    component = connected_components(links.union(out))
    marked = materialize(wide.join(component, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node"), "dense-marked")
    main = marked.groupBy("part", "component").agg(F.count(F.lit(1)).alias("n_in")).groupBy("part").agg(F.max_by("component", F.struct("n_in", "component")).alias("main"))
    marked = marked.join(sized(main, n_parts, 64), "part").withColumn("role", F.when(F.col("component") == F.col("main"), 1).otherwise(0).cast("long"))
    outside = marked.where("role = 0").groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("few"))
    marked = marked.join(sized(outside, n_parts, 64), "part")  # parts that are of one component go
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["part", "few_block", "block", "role", "component", *odd.columns]
    few = marked.where("role = 0").withColumn("few_block", F.pmod(F.xxhash64("part", "doc_id"), F.col("few"))).withColumn("block", every("blocks")).select(columns)
    many = marked.withColumn("role", F.lit(1).cast("long")).withColumn("few_block", every("few")).select(columns)
    more = few.union(many).groupBy("part", "few_block", "block").applyInArrow(_outer_links(least), _LINKS)
    return out.union(materialize(more.where("b is not null and a <> b").select("a", "b"), "outer-links"))


def similar_pairs(docs: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of documents whose union links all that share one of their least shingle hashes and are similar.

    Where up to COMMON documents share a hash all pairs are compared; documents that consist of common shingles
    mostly are compared in blocks, which hand on no more links than they have rows. Sketches only rule pairs out,
    or decide on pairs far from the limit in the blocks; all others are verified on the whole shingle sets. No
    bucket is cut.
    """
    table = materialize(_sketches(docs, words, id_col, text_col), "sketches")
    met = table.select(F.explode("parts").alias("part"), "doc_id", F.size("parts").cast("long").alias("of"))
    # Common parts are counted where they are and never dealt by part: their texts go straight to blocks.
    common = materialize(met.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON).select("part"), "common-parts")
    n_common = common.count()
    few = met.join(sized(common, n_common, 64), "part", "left_anti").repartition("part").sortWithinPartitions("part")
    found = materialize(few.mapInArrow(_meet, "a long, b long, part long, of long"), "part-pairs")
    pairs = found.where("part is null").select("a", "b").distinct()
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    own = table.select("doc_id", "sketch").join(wanted, "doc_id", "left_semi")
    both = pairs.join(own.toDF("a", "sketch_a"), "a").join(own.toDF("b", "sketch_b"), "b")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()
            whole = np.array([max(len(p), len(q)) < 4 * SKETCH for p, q in zip(x, y)], bool)
            good = np.array([similarity(p, q) for p, q in zip(x, y)]) >= np.where(whole, least, least - MARGIN)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(whole)], names=["a", "b", "sure"]).filter(pa.array(good, pa.bool_()))

    sifted = materialize(both.mapInArrow(sift, "a long, b long, sure boolean"), "sifted-pairs")  # so no task runs two Python workers
    texts = _texts(docs, id_col, text_col)
    members = met.join(sized(common, n_common, 64), "part", "left_semi").select("doc_id", "part", "of")
    dense = _dense_links(texts, members, sifted.where("sure").select("a", "b"), least, words, block)
    open_ = sifted.where("not sure").select("a", "b").distinct()
    ids = materialize(open_.select(F.col("a").alias("doc_id")).union(open_.select("b")).distinct(), "open-ids")
    held = texts.join(sized(ids, ids.count(), 64), "doc_id", "left_semi")
    compared = open_.join(held.toDF("a", "text_a"), "a").join(held.toDF("b", "text_b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("text_a"), batch.column("text_b")):
                p, q = np.unique(_digests(x.as_py(), words)), np.unique(_digests(y.as_py(), words))
                shared = len(np.intersect1d(p, q, assume_unique=True))
                good.append(shared / (len(p) + len(q) - shared) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    verified = materialize(compared.mapInArrow(verify, "a long, b long"), "similar-pairs")
    return sifted.where("sure").select("a", "b").union(dense).union(verified)


def drop_near_copies(docs: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each group of near copies; all columns stay as they are.

    Documents are linked if their whole fingerprints (three-word shingles) differ in at most two bits, or if
    they share one of their least shingle hashes and their ``words``-word shingles have a Jaccard similarity of
    ``least`` or more. Rows that share an id stay or go together; rows with a null id stay.
    """
    prints = materialize(fingerprints(docs, 3, id_col, text_col).where("doc_id is not null"), "fingerprints")
    cells, classes = _classes(prints)
    inner = prints.withColumn("salt", _salt()).join(cells, ["fp", "salt"]).select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    outer = cells.join(classes, "fp").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    known = materialize(link_fingerprints(classes).union(inner.union(outer).where("a <> b")), "fingerprint-links")
    edges = known.union(similar_pairs(docs, least, words, id_col, text_col))
    dropped = materialize(connected_components(edges).where("node <> component").select(F.col("node").alias(id_col)), "near-dropped")
    return without(docs, dropped, id_col)
