"""Ranked lexical search over a bit-sliced impact index.

Documents are indexed in blocks of up to 4,096. A block holds, for each term, the places of the documents with it
and their impacts (the term's share of a score, an integer) as bit slices: one bitmap for each binary digit.
A query adds its terms' slices by carry arithmetic on bitmaps, all documents of a block at once and all queries of
a group side by side, and finds its best documents by descending from the most significant slice. Blocks are
searched independently; only each block's best documents meet in one ranking a query.

Building takes two passes: postings with the counts that weights need (documents, terms, documents of a term), then
slices. No posting is shuffled for it. The search shuffles the slices of the queries' terms by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import BROADCAST_BYTES, materialize, sized

#: Documents of a block; occurrences beyond which a block is closed early; terms of a group of queries (on average).
BLOCK_DOCS, BLOCK_HITS, GROUP_TERMS = 4096, 1 << 22, 4096
#: Bytes of UTF-8 as terms see them: letters A-Z in lower case, other ASCII than letters and digits as separators.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, repeats included; a null has none."""
    return text.encode().translate(FOLD).split() if text else []


class _Block:
    """Occurrences of the documents that a task has read since the last block was closed."""

    def __init__(self, vocabulary: dict[bytes, int] | None, most: int):
        self.most, self.fixed, self.code = most, vocabulary is not None, {} if vocabulary is None else vocabulary
        self.ids: list[int | None] = []
        self.lens: list[int] = []
        self.hits: list[np.ndarray] = []
        self.n_hits = 0

    def add(self, doc: int | None, text: str | None) -> None:
        words, code = terms_of(text), self.code
        if self.fixed:
            own = [c for c in map(code.get, words) if c is not None]
        else:
            own = [code.setdefault(w, len(code)) for w in words]
        self.hits.append(np.array(own, np.int64) << 16 | len(self.ids))
        self.ids.append(doc)
        self.lens.append(len(words))
        self.n_hits += len(own)

    def full(self) -> bool:
        return len(self.ids) >= self.most or self.n_hits >= BLOCK_HITS

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """A head with the ids in ascending order (nulls last), then a row a term: places, frequencies, documents' lengths."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place, lens = np.empty(len(order), np.int64), np.array(self.lens, np.int64)
        place[order] = np.arange(len(order))
        head = [[number], [None], [None], [None], [None], [[self.ids[i] for i in order]], [int((lens > 0).sum())], [int(lens.sum())]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(head, _POSTINGS.types)], schema=_POSTINGS)
        hits = np.concatenate(self.hits)
        if not len(hits):
            return
        hits, tf = np.unique(hits & ~0xFFFF | place[hits & 0xFFFF], return_counts=True)
        at, lens, code = (hits & 0xFFFF).astype("<u2"), lens[order].astype("<u8"), hits >> 16
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]])
        names = list(self.code)  # numbered in this order
        for i in range(0, len(cuts) - 1, 1024):
            spans = list(zip(cuts[i : i + 1024].tolist(), cuts[i + 1 : i + 1025].tolist()))
            n = len(spans)
            columns = ([number] * n, [names[code[a]].decode() for a, _ in spans], [at[a:b].tobytes() for a, b in spans], [tf[a:b].astype("<u4").tobytes() for a, b in spans],
                       [lens[at[a:b]].tobytes() for a, b in spans], [None] * n, [None] * n, [None] * n)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _POSTINGS.types)], schema=_POSTINGS)


_POSTINGS = pa.schema([("block", pa.int64()), ("term", pa.string()), ("docs", pa.binary()), ("tf", pa.binary()), ("lens", pa.binary()), ("ids", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64())])


def impacts(weight: int, tf: np.ndarray, lens: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's share of the scores of documents with ``tf`` occurrences of it among ``lens`` terms; whole numbers, divisions round down."""
    m = 10 + (90 * lens * n_docs) // max(n_terms, 1)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def to_slices(values: np.ndarray) -> bytes:
    """Bit slices of the values, least significant first, each padded to whole bytes; none if all are zero."""
    digits = int(values.max(initial=0)).bit_length()
    bits = (values[None, :] >> np.arange(digits)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").tobytes()


def spread(docs: bytes, slices: bytes, words: int) -> np.ndarray:
    """A term's slices as bitmaps over its block: (digits, words) of 64 documents a word."""
    at = np.frombuffer(docs, "<u2")
    bits = np.unpackbits(np.frombuffer(slices, np.uint8).reshape(-1, (len(at) + 7) // 8), axis=1, count=len(at), bitorder="little")
    out = np.zeros((len(bits), words * 64), np.uint8)
    out[:, at] = bits
    return np.packbits(out, axis=1, bitorder="little").view("<u8")


def add_slices(total: np.ndarray, more: np.ndarray) -> None:
    """Adds ``more`` (digits, queries, words) to the first queries of ``total`` in place, carrying from slice to slice."""
    n = more.shape[1]
    carry = np.zeros(more.shape[1:], np.uint64)
    for s in range(len(total)):
        a = total[s, :n]
        if s < len(more):
            either = a ^ more[s]
            both = a & more[s]
            both |= carry & either
            np.bitwise_xor(either, carry, out=a)
            carry = both
        elif carry.any():
            both = a & carry
            a ^= carry
            carry = both
        else:
            break


def best_bits(total: np.ndarray, k: int) -> np.ndarray:
    """Bitmaps (queries, words) of each query's k largest sums above zero; of equal ones the first places."""
    tied = np.bitwise_or.reduce(total, axis=0)
    sure = np.zeros_like(tied)
    for s in range(len(total) - 1, -1, -1):
        here = tied & total[s]
        with_here = sure | here
        n = np.bitwise_count(with_here).sum(axis=1, dtype=np.int64)[:, None]
        sure = np.where(n <= k, with_here, sure)
        tied = np.where(n > k, here, np.where(n < k, tied & ~total[s], np.uint64(0)))
    lacking = k - np.bitwise_count(sure).sum(axis=1, dtype=np.int64)
    for q in np.flatnonzero(tied.any(axis=1) & (lacking > 0)).tolist():
        bits = np.unpackbits(tied[q].view(np.uint8), bitorder="little")
        bits[np.flatnonzero(bits)[lacking[q] :]] = 0
        sure[q] |= np.packbits(bits, bitorder="little").view("<u8")
    return sure


def search_block(n_docs: int, postings: list[tuple[bytes, bytes, list[int]]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of each query's k best documents of a block; ``postings`` are (places, slices, queries with the term)."""
    words = -(n_docs // -64)
    dense = [spread(docs, slices, words) for docs, slices, _ in postings]
    of: dict[int, list[int]] = {}
    for i, (_, _, queries) in enumerate(postings):
        for q in queries:
            of.setdefault(q, []).append(i)
    order = sorted(of, key=lambda q: -len(of[q]))
    if not order:
        return (np.zeros(0, np.int64),) * 3
    digits = max(sum((1 << len(dense[i])) - 1 for i in own).bit_length() for own in of.values())
    total = np.zeros((digits, len(order), words), np.uint64)
    for step in range(len(of[order[0]])):
        terms = [of[q][step] for q in order if len(of[q]) > step]
        more = np.zeros((max(len(dense[i]) for i in terms), len(terms), words), np.uint64)
        for j, i in enumerate(terms):
            more[: len(dense[i]), j] = dense[i]
        add_slices(total, more)
    chosen = np.unpackbits(best_bits(total, k).view(np.uint8), axis=1, bitorder="little")
    query, place = np.nonzero(chosen)
    bits = (total[:, query, place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
    score = (bits.astype(np.int64) << np.arange(digits)[:, None]).sum(axis=0)
    return np.array(order, np.int64)[query], place, score


@dataclass
class ImpactIndex:
    """slices: (block, term, docs, slices); blocks: (block, ids), ids in ascending order; both are tables in the shared folder."""

    slices: DataFrame
    blocks: DataFrame
    n_docs: int
    n_terms: int


def _vocabulary(terms: DataFrame | None) -> dict[bytes, int] | None:
    """The distinct terms, numbered, if they fit the bound of a broadcast; else None: all terms are indexed."""
    if terms is None:
        return None
    known = materialize(terms.select("term").distinct(), "impact-vocabulary")
    size = known.agg(F.coalesce(F.sum(F.octet_length("term") + 128), F.lit(0))).first()[0]
    return {r["term"].encode(): i for i, r in enumerate(known.collect())} if size <= BROADCAST_BYTES else None


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> ImpactIndex:
    """Index all rows of ``docs``. ``terms`` (column ``term``) restricts it to terms that will be asked for; counts cover all.

    A null or empty text has no terms and doesn't count as a document; rows that repeat an id are documents of
    their own; a null id comes after the others; an empty table gives an empty index. Other columns aren't read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_vocabulary(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, _Block(shared.value, block_docs)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(doc, text.as_py())
                if block.full():
                    yield from block.rows(number)
                    number, block = number + 1, _Block(shared.value, block_docs)
        if block.ids:
            yield from block.rows(number)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kept = "block long, term string, docs binary, tf binary, lens binary, ids array<long>, n_docs long, n_terms long"
    postings = materialize(rows.mapInArrow(run, kept), "impact-postings")
    n_docs, n_terms = postings.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    of_terms = postings.where("term is not null")
    counted = of_terms.groupBy("term").agg(F.sum(F.octet_length("docs") / 2).cast("long").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2.0) / (2.0 * F.col("df") + 1.0)))
    weights = materialize(counted.select("term", weight.alias("weight")), "impact-weights")
    n_known, width = weights.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("term")), F.lit(0))).first()

    def slice_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, out = batch.slice(i, 256), []
                for weight, tf, lens in zip(*[part.column(c).to_pylist() for c in ("weight", "tf", "lens")]):
                    out.append(to_slices(impacts(weight, np.frombuffer(tf, "<u4").astype(np.int64), np.frombuffer(lens, "<i8"), n_docs, n_terms)))
                yield pa.RecordBatch.from_arrays([part.column("block"), part.column("term"), part.column("docs"), pa.array(out, pa.binary())], names=["block", "term", "docs", "slices"])

    weighted = of_terms.join(sized(weights, n_known, width + 64), "term").select("block", "term", "docs", "weight", "tf", "lens")
    slices = materialize(weighted.mapInArrow(slice_up, "block long, term string, docs binary, slices binary").where(F.octet_length("slices") > 0), "impact-slices")
    return ImpactIndex(slices, postings.where("term is null").select("block", "ids"), n_docs, n_terms)


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(q, id, terms): a number, the id and the distinct terms of each query; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [[t.decode() for t in sorted(set(terms_of(text)))] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("id"), pa.array(terms, pa.list_(pa.string()))], names=["q", "id", "terms"])

    rows = queries.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(run, "q long, id long, terms array<string>"), "impact-queries")


def search(index: ImpactIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """(id, rank, doc, score): each query's k best documents with a score above zero, equal scores by ascending id.

    ``queries`` come from ``query_terms``. A query without terms, or whose terms no document holds, has no rows;
    rows that repeat a query's id are queries of their own; of documents with equal id and score each counts.
    """
    n_terms = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    groups = max(1, -(n_terms // -GROUP_TERMS))
    exploded = queries.select("q", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("part"), F.explode("terms").alias("term"))
    wanted = materialize(exploded.groupBy("part", "term").agg(F.collect_list("q").alias("qs")), "impact-wanted")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("term") + 8 * F.size("qs") + 64), F.lit(0))).first()[0]
    found = index.slices.join(sized(wanted, 1, size), "term").select("block", "part", "docs", "slices", "qs", F.lit(None).cast("int").alias("n"))
    heads = index.blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(None).cast("binary"), F.lit(None).cast("binary"), F.lit(None).cast("array<long>"), F.size("ids").alias("n"))

    def run(table: pa.Table) -> pa.Table:
        number, n_docs, rows = table["block"][0].as_py(), 0, []
        for docs, slices, qs, n in zip(*[table[c].to_pylist() for c in ("docs", "slices", "qs", "n")]):
            if docs is None:
                n_docs = n
            else:
                rows.append((docs, slices, qs))
        q, place, score = search_block(n_docs, rows, k)
        return pa.table({"q": q, "block": np.full(len(q), number, np.int64), "place": place.astype(np.int32), "score": score})

    best = found.unionByName(heads.toDF(*found.columns)).groupBy("block", "part").applyInArrow(run, "q long, block long, place int, score long")
    # A block's winners: their ids come from the block's head.
    best = best.join(index.blocks, "block").select("q", "score", F.element_at("ids", F.col("place") + 1).alias("doc"))
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    ranked = best.withColumn("rank", first).where(F.col("rank") <= k)
    n_queries = queries.count()
    return ranked.join(sized(queries.select("q", "id"), n_queries, 32), "q").select("id", "rank", "doc", "score")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(query_id, rank, id_col, score): the k best documents for each row of ``queries``; the index holds the terms that they ask for."""
    asked = query_terms(queries, query_id, query_text)
    index = build_index(docs, asked.select(F.explode("terms").alias("term")), id_col, text_col, block_docs)
    return search(index, asked, k).select(F.col("id").alias(query_id), "rank", F.col("doc").alias(id_col), "score")
