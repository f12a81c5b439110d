"""Packing: all limits hold at once, every token lies in one piece, little padding."""

import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm.encoder import encoder, tokenizer_path
from rankloom.llm.packing import Limits, Packer, pack_documents

WORDS = "word_bpe_49k.json"


def padding(lengths, full):
    return sum(0 if n & (n - 1) == 0 else full - n for n in lengths)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 350)), max_size=80), st.integers(1, 64), st.integers(1, 9), st.integers(1, 64))
def test_limits_and_cover(items, tokens, segments, loss):
    p = Packer(Limits(tokens, segments, loss), pool=8)
    for k, (n, quiet) in enumerate(items):
        p.add(k, n, quiet)
    p.finish()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for piece in p.pieces:
        by_doc[piece[0]].append(piece)
        by_seq[piece[3]].append(piece)
    assert set(by_doc) == {k for k, (n, _) in enumerate(items) if n}
    for k, own in by_doc.items():
        at = 0
        for _, start, length, _, _, lossy in sorted(own, key=lambda x: x[1]):
            assert start == at and length > 0
            assert lossy == length - max(0, min(length, min(items[k][1], items[k][0]) - start))
            at += length
        assert at == items[k][0]
    for own in by_seq.values():
        assert sum(x[2] for x in own) <= tokens and len(own) <= segments and sum(x[5] for x in own) <= loss
        at = 0
        for x in sorted(own, key=lambda x: x[4]):
            assert x[4] == at
            at += x[2]


def test_padding_is_little_when_only_tokens_bind():
    p = Packer(Limits())
    for k in range(5000):
        p.add(k, 1 + k * 7919 % 3000, 1)
    p.finish()
    used = defaultdict(int)
    for x in p.pieces:
        used[x[3]] += x[2]
    assert padding(used.values(), 4096) == 0


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, "Hello world. " * 3000), (3, "again"), (None, "no id"), (5, "a\n\nb")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS id", "1 AS start").repartition(2)
    got = pack_documents(df, tokenizer_path(WORDS), 2).collect()
    e, want = encoder(tokenizer_path(WORDS)), defaultdict(list)
    for i, t in rows:
        want[i].append(zlib.crc32(e.encode([t])[0] + b"\2\0\0\0"))
    for i in {i for i, _ in rows} - {3}:
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert zlib.crc32(b"".join(bytes(r.ids) for r in own)) == want[i][0]
        assert {r.doc_tokens for r in own} == {sum(r.length for r in own)}
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    for own in seqs.values():
        assert sorted(r.offset for r in own)[0] == 0 and sum(r.length for r in own) <= 4096
    assert pack_documents(df.limit(0), tokenizer_path(WORDS), 2).count() == 0
