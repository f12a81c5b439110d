"""Exact tokenizer encoding at several times the library's speed, by memoising space-delimited pieces.

Both tokenizers' pre-tokenizers always break at a space that a non-space character follows, and at a line
feed between two of them, and no pre-token looks across such a break: a text's ids are the concatenated
ids of its pieces. A piece keeps the space before it where the tokenizer does. Each distinct piece is
encoded once by the tokenizers library and kept in a bounded dictionary; natural text repeats most of its
pieces. Texts with other runs of white space are split only where that is safe.

The file's added tokens (``<|endoftext|>``) in a text get their own ids, as the library has it; what stands between
them is encoded on its own. A file with added tokens that strip, fold or match whole words only is left to the library.
"""

from __future__ import annotations

import os
import re
from array import array

from rankloom.llm.common import worker_cache

#: The characters with Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = re.compile(f"[{WHITE}](?=[{WHITE}]|$)")
_BREAK = re.compile(f" (?=[^{WHITE}])")
#: A word of Latin letters and the ASCII punctuation after it: one pre-token each.
_WORD = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([-!\"#$%&()*+,./:;<=>?@\\[\\]^_`{|}~]*)")
#: Pieces kept in a dictionary before it starts anew, and the longest piece that is kept.
KEPT_PIECES, KEPT_CHARS = 700_000, 48


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's rule: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class Pieces(dict):
    """Piece -> its ids as bytes; encodes what it doesn't know yet."""

    def __init__(self, owner: Encoder, before: str):
        super().__init__()
        self.owner, self.before = owner, before

    def __missing__(self, piece: str) -> bytes:
        owner, word = self.owner, _WORD.fullmatch(piece)
        if word is None:
            ids = owner.plain(self.before + piece) if piece else b""
        elif word[2]:
            ids = self[word[1]] + owner.tails[word[2]]
        else:
            ids = owner.word(self.before + piece)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= owner.kept:
                self.clear()
            self[piece] = ids
        return ids


class Tails(Pieces):
    """Punctuation right after a word."""

    def __missing__(self, piece: str) -> bytes:
        ids = self.owner.plain(piece)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= 10_000:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts with a public tokenizer file; ids come as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        self.plain_only = any(t.lstrip or t.rstrip or t.single_word or t.normalized or set(t.content) & set(" \n") for t in added.values())
        self._added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.kept = kept
        self.model = self.tokenizer.model
        self.folds = self.tokenizer.normalizer is not None  # lower case; white space is dropped
        self.line_feed = self.plain("\n")
        self.tails = Tails(self, "")
        self.after_space = Pieces(self, " ")
        self.bare = self.after_space if self.folds else Pieces(self, "")

    def plain(self, text: str) -> bytes:
        """The library's ids of any text."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        """Ids of one Latin word with or without a space before it: it is a single pre-token, so the library's model takes it."""
        if self.folds:
            text = text.strip().lower()
        raw = ("" if self.folds else text[: text[0] == " "]) + text.lstrip()
        return array("I", [t.id for t in self.model.tokenize(raw.encode().decode("latin-1").translate(_LETTERS))]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null counts as the empty text."""
        return [self.encode_one(t) if t else b"" for t in texts]

    def encode_one(self, text: str) -> bytes:
        if self.plain_only:
            return self.plain(text)
        if any(t in text for t in self.added):
            between = self._added.split(text)
            marks = [self.added[t] for t in self._added.findall(text)]
            return b"".join(x for pair in zip([self._between(t) if t else b"" for t in between], [*marks, b""]) for x in pair)
        return self._between(text)

    def _between(self, text: str) -> bytes:
        """A text without added tokens."""
        known, bare = self.after_space.__getitem__, self.bare.__getitem__
        if _ODD.search(text):
            first, *rest = _BREAK.split(text)
            return b"".join([self.plain(first), *map(known, rest)])
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(b"".join([bare(first), *map(known, rest)]))
        return self.line_feed.join(lines)


def encoder(path: str, kept: int = KEPT_PIECES) -> Encoder:
    """This Python worker's encoder for a tokenizer file."""
    own = worker_cache("encoders")
    if (path, kept) not in own:
        own[path, kept] = Encoder(path, kept)
    return own[path, kept]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; installed on every executor, never shipped with the code."""
    import public_tokenizers

    return public_tokenizers.path(name)
