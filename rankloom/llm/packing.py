"""Vector bin packing of tokenised examples into training sequences.

Every sequence has simultaneous limits on tokens, segments and loss-bearing tokens. The dot-product
heuristic fills one sequence at a time: of the waiting examples that fit in all three dimensions the one
whose demand has the largest dot product with the sequence's remaining capacity goes in. If none fits,
the best one is cut to fill the gap. Each task packs what it scans, so no row is shuffled and memory
holds a bounded pool of examples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.encoder import KEPT_PIECES, encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"
#: Waiting examples from which the next one is chosen.
POOL = 512
RUN_DOCS = 128


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens of a sequence."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


class Packer:
    """Packs examples one after another; ``pieces`` holds (key, start, length, sequence, offset, loss)."""

    def __init__(self, limits: Limits, pool: int = POOL):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("limits are at least 1")
        self.limits, self.pool = limits, pool
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.keys: list = []
        self.start = np.zeros(2 * pool, np.int64)
        self.left = np.zeros(2 * pool, np.int64)  # tokens not yet placed
        self.quiet = np.zeros(2 * pool, np.int64)  # of these, leading ones without loss
        self.pieces: list[tuple] = []
        self.sequence, self.room = 0, self.cap.copy()

    def add(self, key, tokens: int, quiet: int = 0) -> None:
        """An example; its first ``quiet`` tokens bear no loss."""
        if tokens <= 0:
            return
        if len(self.keys) == len(self.left):
            self._pack(self.pool)
        n = len(self.keys)
        self.keys.append(key)
        self.start[n], self.left[n], self.quiet[n] = 0, tokens, min(max(quiet, 0), tokens)

    def _take(self, i: int, length: int) -> None:
        loss = length - min(length, int(self.quiet[i]))
        offset = self.limits.tokens - int(self.room[0])
        self.pieces.append((self.keys[i], int(self.start[i]), length, self.sequence, offset, loss))
        self.room -= (length, 1, loss)
        self.start[i] += length
        self.left[i] -= length
        self.quiet[i] = max(0, int(self.quiet[i]) - length)
        if not self.left[i]:
            last = self.keys.pop()
            n = len(self.keys)
            if i < n:
                self.keys[i] = last
                for x in (self.start, self.left, self.quiet):
                    x[i] = x[n]

    def _close(self) -> None:
        self.sequence += 1
        self.room = self.cap.copy()

    def _pack(self, until: int) -> None:
        while len(self.keys) > until:
            n = len(self.keys)
            tokens = self.left[:n]
            loss = tokens - self.quiet[:n]
            score = tokens * (self.room[0] / self.cap[0] ** 2) + loss * (self.room[2] / self.cap[2] ** 2)
            fits = (tokens <= self.room[0]) & (loss <= self.room[2])
            if fits.any():
                self._take(i := int(np.argmax(np.where(fits, score, -1.0))), int(tokens[i]))
            else:
                i = int(np.argmax(score))
                self._take(i, int(min(self.room[0], self.quiet[i] + self.room[2], self.left[i])))
            if self.room.min() < 1:
                self._close()

    def finish(self) -> None:
        """Places the rest. What the last sequence holds is dealt anew into sequences of power-of-two lengths, which need no padding."""
        self._pack(0)
        last = [p for p in self.pieces if p[3] == self.sequence]
        if not last:
            return
        del self.pieces[-len(last) :]
        used = sum(p[2] for p in last)
        fill, size, offset = used, 1 << (used.bit_length() - 1), 0
        for key, start, length, _, _, loss in last:
            quiet = length - loss
            while length:
                n = min(length, size - offset)
                lossy = n - min(n, quiet)
                self.pieces.append((key, start, n, self.sequence, offset, lossy))
                start, length, quiet, offset, fill = start + n, length - n, max(0, quiet - n), offset + n, fill - n
                if offset == size:
                    self._close()
                    offset, size = 0, 1 << (fill.bit_length() - 1) if fill else 1


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int, limits: Limits = Limits(), quiet: Column | None = None, id_col: str = "doc_id", text_col: str = "text", kept_pieces: int = KEPT_PIECES) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, loss_tokens.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. ``quiet`` counts the
    leading tokens that bear no loss (a prompt); by default the first one, which nothing predicts. Every
    token lies in exactly one piece. Rows that repeat an id are packed one by one; an empty table gives no
    pieces; other columns are not read. A sequence id is the task's number times 2**32 plus a count.
    ``kept_pieces`` bounds the encoder's dictionary in each Python worker.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.lit(1) if quiet is None else quiet).cast("long").alias("quiet"))
    end = int(end_id).to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits)
        base = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}  # document's place in the task -> [id, ids, tokens not yet handed on]
        place = 0

        def hand_on(done: bool) -> Iterator[pa.RecordBatch]:
            # The open sequence may be dealt anew at the end, so its pieces wait.
            ready = packer.pieces if done else [p for p in packer.pieces if p[3] < packer.sequence]
            packer.pieces = [] if done else packer.pieces[len(ready) :]
            for i in range(0, len(ready), 1024):
                rows = []
                for key, start, length, sequence, offset, loss in ready[i : i + 1024]:
                    doc = held[key]
                    rows.append((doc[0], start, length, doc[1][4 * start : 4 * (start + length)], len(doc[1]) // 4, base + sequence, offset, loss))
                    doc[2] -= length
                    if not doc[2]:
                        del held[key]
                names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows))], names=names)

        for batch in batches:
            for i in range(0, batch.num_rows, RUN_DOCS):
                part = batch.slice(i, RUN_DOCS)
                texts = part.column("text").to_pylist()
                for doc_id, ids, silent in zip(part.column("id").to_pylist(), encoder(tokenizer_file, kept_pieces).encode(texts), part.column("quiet").to_pylist()):
                    ids += end
                    held[place] = [doc_id, ids, len(ids) // 4]
                    packer.add(place, len(ids) // 4, silent or 0)
                    place += 1
                yield from hand_on(False)
        packer.finish()
        yield from hand_on(True)

    return rows.mapInArrow(pack, SCHEMA)
