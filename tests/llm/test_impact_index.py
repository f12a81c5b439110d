"""Ranked search: slices against whole numbers, ranking against brute force, edges."""

import math
import random
import re

import numpy as np
import pytest

from rankloom.llm import impact_index
from rankloom.llm.impact_index import add_slices, best_bits, build_index, query_terms, rank_documents, search, search_block, spread, terms_of, to_slices

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if text else []


def brute(docs, items, k=10):
    docs = [(i, plain_terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    out = []
    for item, text in items:
        scores = [0] * len(docs)
        for term in set(plain_terms(text)):
            df = sum(term in t for _, t in docs)
            if df:
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                for d, (_, t) in enumerate(docs):
                    if tf := t.count(term):
                        scores[d] += w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(t) * n_docs) // n_terms)))
        best = sorted((-s, i is None, i or 0, i) for (i, _), s in zip(docs, scores) if s > 0)[:k]
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def test_terms_follow_the_pattern():
    rng = random.Random(4)
    chars = [chr(c) for c in [*range(0, 200), 0x3042, 0x1F600, 0x2028, 0x85, 0xA0]]
    for _ in range(500):
        text = "".join(rng.choice(chars) for _ in range(rng.randrange(40)))
        assert [t.decode() for t in terms_of(text)] == plain_terms(text)


def test_slices_hold_and_add_numbers():
    rng = np.random.default_rng(5)
    total, sums = np.zeros((44, 3, 5), np.uint64), np.zeros((3, 320), np.int64)
    for _ in range(9):
        top = int(rng.integers(1, 38))
        more, queries = np.zeros((38, 3, 5), np.uint64), int(rng.integers(1, 4))
        for q in range(queries):
            at = np.sort(rng.choice(320, int(rng.integers(1, 320)), replace=False))
            values = rng.integers(0, 1 << top, len(at))
            bits = spread(at.astype("<u2").tobytes(), to_slices(values), 5)
            more[: len(bits), q] = bits
            sums[q, at] += values
        add_slices(total, more[:, :queries])
    whole = np.unpackbits(total.view(np.uint8), axis=2, bitorder="little").astype(np.int64)
    assert ((whole << np.arange(44)[:, None, None]).sum(0) == sums).all()
    for k in (1, 7, 200, 400):
        chosen = np.unpackbits(best_bits(total, k).view(np.uint8), axis=1, bitorder="little")
        for q in range(3):
            best = sorted((-s, i) for i, s in enumerate(sums[q].tolist()) if s > 0)[:k]
            assert np.flatnonzero(chosen[q]).tolist() == sorted(i for _, i in best)


def test_ties_at_the_edge_go_to_the_first_places():
    at = np.arange(100, dtype="<u2").tobytes()
    postings = [(at, to_slices(np.full(100, 6)), [8, 9]), (np.array([70], "<u2").tobytes(), to_slices(np.array([1])), [9])]
    q, place, score = search_block(100, postings, 3)
    assert sorted(zip(q.tolist(), place.tolist(), score.tolist())) == [(8, 0, 6), (8, 1, 6), (8, 2, 6), (9, 0, 6), (9, 1, 6), (9, 70, 7)]


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["Ab", "ÉCLAIR", "x1", "zoo", "the", "THE", "of", "日本", "naïve", *[f"w{i}" for i in range(300)]]
    text = lambda m: "".join(rng.choice(words if rng.random() < 0.5 else words[:8]) + rng.choice([" ", "-", "\n", "! ", "'"]) for _ in range(rng.randrange(m)))
    docs = [(i, text(60)) for i in rng.sample(range(10 * n), n)]
    docs += [(20 * n + i, docs[0][1]) for i in range(60)] + [(None, docs[1][1]), (3, None), (5, ""), (7, "--"), (docs[2][0], docs[2][1]), (99999, "zoo " * 30000)]
    rng.shuffle(docs)
    items = [(i, text(25)) for i in range(30)] + [(100, None), (101, "--"), (102, "nowhere"), (103, docs[0][1] or "the"), (1, "the zoo")]
    return docs, items


@pytest.mark.parametrize("block", [64, 4096])
def test_ranking_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(impact_index, "GROUP_TERMS", 40)
    docs, items = corpus(block)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = rank_documents(frame, asked, block_docs=block)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_an_index_of_all_terms_answers_later_queries(spark):
    docs, items = corpus(8, 120)
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    for part in (items[:20], items[20:]):
        got = search(index, query_terms(spark.createDataFrame(part, "item_id long, text string")), 4)
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, part, 4)


def test_a_vocabulary_beyond_the_bound_indexes_all_terms(spark, monkeypatch):
    monkeypatch.setattr(impact_index, "BROADCAST_BYTES", 10)
    docs, items = corpus(9, 80)
    got = rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, block long, term long")
    items = spark.createDataFrame([(1, "b c", 2)], "item_id long, text string, q long")
    assert [tuple(r)[:3] for r in rank_documents(docs, items).collect()] == [(1, 1, 1)]
    assert rank_documents(docs.limit(0), items).count() == 0
    assert rank_documents(docs, items.limit(0)).count() == 0
