"""Edit-aware token counts.

A document is cut, where every pre-token ends, into leaves of about LEAF characters; a tree of lengths and token
counts stands above them. Cuts stand before white space that a visible character follows, and between a letter and
a punctuation mark, so texts of lines, and of scripts without spaces, are cut too. Only one run of letters, or of
digits or marks, is never cut: to the tokenizer it is one pre-token. No cut stands where an added token may be.
A cut is known by the character before it and the two after it: an edit re-encodes the leaves it touches, with the one
before or after if it reaches that far, and updates the nodes above them. The rest of the text is never encoded, copied
or counted again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.encoder import WHITE, Encoder, encoder

LEAF, FAN = 256, 8
#: Letters and marks that every version of Unicode has as such.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0905-\u0939\u0e01-\u0e2e\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u060c\u061b\u061f\u0964\u3001\u3002\u300c\u300d\uff01\uff0c\uff1a\uff1b\uff1f"


def cut_pattern(added: Iterable[str]) -> re.Pattern:
    """Where a text may be cut; never within, right before or one space before an added token."""
    first = "".join(sorted({t[0] for t in added}))
    marks = "".join(c for c in _MARKS if not any(c in t for t in added))
    return re.compile(f"[{WHITE}\n](?=[^{WHITE}\n{re.escape(first)}])|(?<=[{_LETTERS}])(?=[{re.escape(marks)}])")


_patterns: dict[tuple[str, ...], re.Pattern] = {}

EDIT = "struct<start: int, end: int, text: string>"
#: Spans that the redaction of the registered query replaces: e-mail addresses, long hexadecimal secrets, long numbers.
SECRETS = r"[\w.+-]+@[\w-]+\.[\w.]+|\b[0-9a-f]{16,64}\b|\b\d{9,}\b"


def cuts(text: str, begin: int, end: int, added: Iterable[str] = ()) -> list[int]:
    """Where leaves of text[begin:end] start, the first at ``begin``."""
    key = tuple(added)
    pattern = _patterns.get(key) or _patterns.setdefault(key, cut_pattern(key))
    out, at = [begin], begin + LEAF
    while at < end and (found := pattern.search(text, at, end)):
        out.append(found.start())
        at = found.start() + LEAF
    return out


def leaf_sizes(text: str, own: Encoder) -> list[tuple[int, int]]:
    """(characters, tokens) of a text's leaves."""
    starts = [0] if own.plain_only else cuts(text, 0, len(text), own.added)
    parts = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
    return [(len(p), len(own.encode_one(p)) // 4 if p else 0) for p in parts]


class TokenTree:
    """A text's leaves and the sums above them.

    A leaf is its text with its token count; leaves stand in runs of at most 2 * FAN, and runs in runs. Every
    node holds how many characters and tokens lie below it and nothing about what stands before it, so an edit
    changes the leaves it touches and the nodes above them: the cost is the path, not the text.
    """

    def __init__(self, text: str, own: Encoder, leaves: list[tuple[int, int]] | None = None):
        """``leaves``: (characters, tokens) of each leaf, if they are known."""
        self.own, self.encoded = own, 0
        self.root = _grown(self._leaves(text) if leaves is None else self._nodes(text, leaves))

    def _leaves(self, text: str) -> list[Node]:
        self.encoded += len(text)
        return self._nodes(text, leaf_sizes(text, self.own))

    @staticmethod
    def _nodes(text: str, sizes: list[tuple[int, int]]) -> list[Node]:
        out, at = [], 0
        for n, tokens in sizes:
            out.append(Node(n, tokens, text=text[at : at + n]))
            at += n
        return out

    @property
    def total(self) -> int:
        return self.root.tokens

    @property
    def text(self) -> str:
        return "".join(x.text for x in self.root.leaves())

    def leaves(self) -> list[tuple[int, int]]:
        return [(x.chars, x.tokens) for x in self.root.leaves()]

    def edit(self, start: int, end: int, replacement: str) -> None:
        """text[start:end] becomes ``replacement``: the leaves from the last that begins two characters before the edit to the one that holds the character after it are made anew."""
        first, begin = self.root.leaf_at(max(start - 2, 0))
        held, reached = [first.text], begin + first.chars
        while reached <= end and reached < self.root.chars:
            x, at = self.root.leaf_at(reached)
            held.append(x.text)
            reached = at + x.chars
        old = "".join(held)
        new = old[: start - begin] + replacement + old[end - begin :]
        self.root = _grown(self.root.replaced(begin, reached, self._leaves(new) if new else []) if self.root.chars else self._leaves(new))


@dataclass
class Node:
    """A leaf (with its text) or a run of nodes below it."""

    chars: int
    tokens: int
    below: list[Node] | None = None
    text: str = ""

    def leaves(self) -> Iterator[Node]:
        if self.below is None:
            yield self
        else:
            for x in self.below:
                yield from x.leaves()

    def leaf_at(self, at: int) -> tuple[Node, int]:
        """The leaf that holds a character (the last one at the text's end), and where it begins."""
        node, begin = self, 0
        while node.below is not None:
            for i, x in enumerate(node.below):
                if at < begin + x.chars or i == len(node.below) - 1:
                    node = x
                    break
                begin += x.chars
        return node, begin

    def replaced(self, begin: int, end: int, fresh: list[Node]) -> list[Node]:
        """What stands in this node's place when the leaves of characters begin to end give way to ``fresh``; untouched nodes stay as they are."""
        if self.below is None:
            return fresh
        out, at = [], 0
        for x in self.below:
            if at + x.chars <= begin or at >= end:
                out.append(x)
            else:
                out += x.replaced(max(begin - at, 0), min(end - at, x.chars), fresh)
                fresh = []  # only the first of them makes room
            at += x.chars
        return _runs(out)


def _runs(nodes: list[Node]) -> list[Node]:
    """Nodes in runs of at most 2 * FAN, each under a node of its own."""
    if not nodes:
        return []
    n = -(len(nodes) // -(2 * FAN))
    size = -(len(nodes) // -n)
    return [Node(sum(x.chars for x in run), sum(x.tokens for x in run), run) for run in (nodes[i : i + size] for i in range(0, len(nodes), size))]


def _grown(nodes: list[Node]) -> Node:
    """One node above all."""
    while len(nodes) != 1:
        nodes = _runs(nodes) or [Node(0, 0)]
    return nodes[0]


def in_order(edits: list[dict] | None, size: int) -> list[tuple[int, int, str]]:
    """Edits clipped to the text and sorted; nulls, and edits that overlap an earlier one, are left out."""
    out, reached = [], 0
    clean = [e for e in edits or [] if e is not None and e["start"] is not None and e["end"] is not None]
    for e in sorted(clean, key=lambda e: (e["start"], e["end"])):
        a, b = max(0, min(e["start"], size)), max(0, min(e["end"], size))
        if a >= reached and b >= a:
            out.append((a, b, e["text"] or ""))
            reached = b
    return out


TREE = "leaf_chars array<int>, leaf_tokens array<int>, n_tokens long"
_INTS = pa.list_(pa.int32())


def token_trees(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """Per row: id, text, edits (if given), leaf_chars, leaf_tokens, n_tokens. Null texts count as empty; rows that repeat are kept."""
    edits = F.col(edits_col).cast(f"array<{EDIT}>") if edits_col else F.lit(None).cast(f"array<{EDIT}>")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), edits.alias("edits"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_file)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sizes = [list(zip(*leaf_sizes(t, own))) for t in part.column("text").to_pylist()]
                more = [*[pa.array([x[k] for x in sizes], _INTS) for k in (0, 1)], pa.array([sum(x[1]) for x in sizes], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=["id", "text", "edits", "leaf_chars", "leaf_tokens", "n_tokens"])

    return rows.mapInArrow(build, f"id long, text string, edits array<{EDIT}>, {TREE}")


def apply_edits(trees: DataFrame, tokenizer_file: str) -> DataFrame:
    """Per row of ``token_trees``: the edited text with its tree, n_tokens_before, n_edits and encoded_chars (characters encoded for the edits).

    Edits hold positions of the text before; one that overlaps an earlier one is left out, positions beyond
    the text are clipped, a null replacement deletes.
    """

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_file)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, out = batch.slice(i, 256), []
                for r in part.to_pylist():
                    todo = in_order(r["edits"], len(r["text"]))
                    if not todo:
                        out.append((r["id"], r["text"], r["leaf_chars"], r["leaf_tokens"], r["n_tokens"], r["n_tokens"], 0, 0))
                        continue
                    tree = TokenTree(r["text"], own, list(zip(r["leaf_chars"], r["leaf_tokens"])))
                    for a, b, replacement in reversed(todo):
                        tree.edit(a, b, replacement)
                    out.append((r["id"], tree.text, *map(list, zip(*tree.leaves())), tree.total, r["n_tokens"], len(todo), tree.encoded))
                kinds = (pa.int64(), pa.string(), _INTS, _INTS, pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "n_tokens_before", "n_edits", "encoded_chars"])

    return trees.mapInArrow(edit, f"id long, text string, {TREE}, n_tokens_before long, n_edits long, encoded_chars long")


def redactions(docs: DataFrame, pattern: str = SECRETS, replacement: str = "[removed]", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``edits`` that replaces every match of a pattern."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = re.compile(pattern).finditer
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [[{"start": m.start(), "end": m.end(), "text": replacement} for m in search(t)] if t else [] for t in part.column(text_col).to_pylist()]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=[*part.schema.names, "edits"])

    docs = docs.drop("edits")
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(find, f"{kinds}, edits array<{EDIT}>")
