"""Token ids of a corpus in binary shards of patched frame-of-reference blocks.

Shard layout: magic, blocks, document table (ids, ends), block starts, JSON footer, footer length, magic.
Each task writes one shard under a name of its own attempt and reports it as a manifest row; readers open
only shards the manifest lists, so a retried or speculative task leaves at most an unlisted file. Shards
hold ascending ids and follow one another in ascending id order.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import pfor
from rankloom.llm.common import materialize, open_fs, work_dir
from rankloom.llm.encoder import encoder

MAGIC = b"PFORIDS1"
#: Texts that one encoding call takes.
RUN_DOCS = 256

_MANIFEST = "shard int, file string, n_docs long, n_tokens long, n_bytes long"
_READ = "id long, start long, n_tokens long, ids_crc32 long"


class ShardWriter:
    """Streams documents into one shard; holds one block of ids and 16 bytes a document."""

    def __init__(self, sink):
        self.sink, self.at, self.starts, self.ids, self.ends = sink, 0, [], [], []
        self.waiting, self.n_waiting, self.total = [], 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.total += len(ids)
        self.ids.append(doc_id)
        self.ends.append(self.total)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= 16 * pfor.BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        whole = len(values) if last else len(values) // pfor.BLOCK * pfor.BLOCK
        for i in range(0, whole, pfor.BLOCK):
            self.starts.append(self.at)
            self._put(pfor.encode_block(values[i : min(i + pfor.BLOCK, whole)]))
        self.waiting, self.n_waiting = [values[whole:]], len(values) - whole

    def close(self) -> int:
        """Writes what waits and the footer; returns the shard's bytes."""
        self._flush(True)
        missing = [i for i, d in enumerate(self.ids) if d is None]
        table = self.at
        self._put(np.array([0 if d is None else d for d in self.ids], "<i8").tobytes())
        self._put(np.array(self.ends, "<u8").tobytes())
        index = self.at
        self._put(np.array(self.starts, "<u8").tobytes())
        footer = json.dumps({"docs": len(self.ids), "tokens": self.total, "blocks": len(self.starts), "block": pfor.BLOCK, "table": table, "index": index, "null_ids": missing}).encode()
        self._put(footer + len(footer).to_bytes(8, "little") + MAGIC)
        return self.at


class ShardReader:
    """Random access to one shard's documents; reads only the blocks a document touches."""

    def __init__(self, source):
        self.source = source
        tail = self._at(source.size() - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token shard")
        n = int.from_bytes(tail[:8], "little")
        self.meta = m = json.loads(self._at(source.size() - 16 - n, n))
        self.ids = np.frombuffer(self._at(m["table"], 8 * m["docs"]), "<i8")
        self.ends = np.frombuffer(self._at(m["table"] + 8 * m["docs"], 8 * m["docs"]), "<u8").astype(np.int64)
        self.starts = np.append(np.frombuffer(self._at(m["index"], 8 * m["blocks"]), "<u8"), m["table"]).astype(np.int64)

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids at positions start to end of the shard."""
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // pfor.BLOCK, (end - 1) // pfor.BLOCK
        data, got, at = self._at(int(self.starts[first]), int(self.starts[last + 1] - self.starts[first])), [], 0
        for _ in range(first, last + 1):
            values, at = pfor.decode_block(data, at)
            got.append(values)
        return np.concatenate(got)[start - first * pfor.BLOCK : end - first * pfor.BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, position in the shard, token ids) of each document, about 64 blocks at a time."""
        nulls, begin, i = set(self.meta["null_ids"]), 0, 0
        while i < len(self.ids):
            j = max(i + 1, int(np.searchsorted(self.ends, begin + 64 * pfor.BLOCK, "right")))
            run = self.tokens(begin, int(self.ends[j - 1]))
            base = begin
            for k in range(i, j):
                end = int(self.ends[k])
                yield None if k in nulls else int(self.ids[k]), begin, run[begin - base : end - base]
                begin = end
            i = j


def write_tokens(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and write shards into ``folder``; returns the manifest.

    Null and empty texts give the end id alone; null ids come first; documents that repeat an id follow one
    another. An empty table gives an empty manifest. Other columns are not read.
    """
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Null and much repeated ids are spread over several shards by a hash of their text; shards ascend by (id, hash).
    ordered = ordered.withColumn("place", F.xxhash64("text")).repartitionByRange("id", "place").sortWithinPartitions("id", "place").drop("place")
    end = int(end_id).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        shard = TaskContext.get().partitionId()
        name, writer, sink = f"shard-{shard:06d}-{uuid.uuid4().hex}.pfor", None, None
        for batch in batches:
            for i in range(0, batch.num_rows, RUN_DOCS):
                part = batch.slice(i, RUN_DOCS)
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer = ShardWriter(sink)
                for doc_id, ids in zip(part.column("id").to_pylist(), encoder(tokenizer_file).encode(part.column("text").to_pylist())):
                    writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            n = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": [len(writer.ids)], "n_tokens": [writer.total], "n_bytes": [n]})

    return materialize(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the manifest's shards: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    shards = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as source:
                    rows = [(d, base + at, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())) for d, at, ids in ShardReader(source).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, min(shards, 4096))).mapInArrow(read, _READ)


def encode_corpus(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the corpus's token file in the shared folder and read it back, one row per document."""
    folder = work_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer_file, end_id, folder, id_col, text_col), folder).withColumnRenamed("id", id_col)


def dump(ids: list[np.ndarray]) -> bytes:
    """A shard in memory, documents numbered from 0."""
    sink = io.BytesIO()
    writer = ShardWriter(sink)
    for i, x in enumerate(ids):
        writer.add(i, x)
    writer.close()
    return sink.getvalue()
