"""Encoder and token shards: equal to the library's ids, exact round trips."""

import io
import zlib
from array import array

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import pfor
from rankloom.llm.encoder import encoder, tokenizer_path
from rankloom.llm.token_file import ShardReader, dump, encode_corpus

ODD = st.text(alphabet=" \n\t\x1c\x1f\xa0　ab'sé1Σσ̈.<|>endoftx", max_size=40)


def direct(tok, text):
    return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), ODD))
def test_encoder_equals_library(text):
    for f in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(tokenizer_path(f))
        assert e.encode([text, None]) == [direct(e.tokenizer, text), b""]


SPECIAL = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "<|ENDOFTEXT|>", "word", "Words.", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "1", "<", "|>"]), max_size=14).map("".join)


@settings(max_examples=500, deadline=None)
@given(SPECIAL)
def test_added_tokens_in_a_text_equal_the_library(text):
    from tokenizers import Tokenizer

    for f in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = tokenizer_path(f)
        assert encoder(path).encode([text]) == [direct(_library.setdefault(path, Tokenizer.from_file(path)), text)]


_library: dict = {}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300)), min_size=1, max_size=400))
def test_block_round_trip(values):
    v = np.array(values, np.uint32)
    got, end = pfor.decode_block(data := pfor.encode_block(v))
    assert (got == v).all() and end == len(data)


def test_outliers_are_exceptions():
    v = np.full(8192, 7, np.uint32)
    v[::100] = 4_000_000_000
    assert len(pfor.encode_block(v)) < 1000


def test_shard_round_trip():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50257, n).astype(np.uint32) for n in (0, 1, 70_000, 0, 8192, 8191, 3)]

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = ShardReader(Source(dump(docs)))
    for (i, _, got), want in zip(reader.documents(), docs, strict=True):
        assert (got == want).all()
    assert (reader.tokens(100, 9000) == docs[2][99:8999]).all()


def test_query_against_plain_encoding(spark):
    rows = [(5, "hello  world\n\nthe end"), (1, None), (3, ""), (2, "word " * 60_000), (9, "a\x1cb é"), (2, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS file")
    got = encode_corpus(df, tokenizer_path("byte_bpe_50k.json"), 2).collect()
    tok, start = encoder(tokenizer_path("byte_bpe_50k.json")).tokenizer, 0
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [1, 2, 2, 3, 5, 9]
    want = {(i, zlib.crc32(direct(tok, t or "") + b"\2\0\0\0")) for i, t in rows}
    assert {(r.doc_id, r.ids_crc32) for r in got} == want
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert encode_corpus(df.limit(0), tokenizer_path("byte_bpe_50k.json"), 2).count() == 0
