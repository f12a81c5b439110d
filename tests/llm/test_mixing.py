"""Pfair mixing: deadlines met, less than one block of deviation at every slot, every document placed once."""

from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from rankloom.llm.mixing import in_mixed_order, mix, one_period, schedule, shares


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(0.001, 1000), min_size=1, max_size=30))
def test_one_period_keeps_every_prefix_within_a_block(weights):
    a = shares(np.array(weights), 256)
    assert a.sum() == 256 and (a >= 1).all()
    slots = one_period(a)
    owner = {int(t): i for i, s in enumerate(slots) for t in s}
    assert sorted(owner) == list(range(256))
    given_ = Counter()
    for t in range(256):
        given_[owner[t]] += 1
        for i, x in enumerate(a.tolist()):
            assert abs(given_[i] - Fraction(x * (t + 1), 256)) < 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 700), st.floats(0, 10)), min_size=1, max_size=8))
def test_schedule_places_each_block_once_within_its_window(sources):
    blocks, weights = np.array([b for b, _ in sources]), np.array([w for _, w in sources])
    plan, seen = schedule(blocks, weights), []
    for i, n in enumerate(blocks):
        slot, release, due = plan.place(i, np.arange(n))
        assert ((release <= slot) & (slot < due)).all() and (np.diff(slot) > 0).all()
        seen += slot.tolist()
    assert sorted(seen) == list(range(int(blocks.sum())))


def documents(spark):
    rows = [(i, "abcdefghij" * (i % 7), f"s{min(i % 10, 3)}") for i in range(1500)]
    rows += [(2000, None, None), (2001, "", None), (2002, "x" * 5000, "s1"), (5, "again", "s0"), (5, "again", "s0")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS mix_slot", "2 AS id", "'z' AS s").repartition(4), rows


def test_documents_follow_the_weights(spark):
    docs, rows = documents(spark)
    got = mix(docs, {"s0": 1, "s1": 1, "s2": 2}, block=100).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    size = defaultdict(int)
    for r in got:
        size[r.source] += max(1, len(r.text or ""))
        assert r.mix_release <= r.mix_slot < r.mix_deadline
    slots = defaultdict(set)
    for r in got:
        slots[r.source].add(r.mix_slot)
    first_end = min(max(slots[s]) for s in ("s0", "s1", "s2"))
    assert min(slots["s3"] | slots[None]) > first_end  # no weight: after the others
    by_source = sorted((r.source or "", r.mix_block, r.mix_at) for r in got)
    assert len(set(by_source)) == len(by_source)


def test_order_and_empty(spark):
    docs, rows = documents(spark)
    ordered = in_mixed_order(docs, block=100)
    assert ordered.columns == docs.columns and ordered.where("mix_slot = 1").count() == len(rows)
    slot = {(r.doc_id, r.source): (r.mix_slot, r.mix_at) for r in mix(docs, block=100).collect()}
    at = [slot[r.doc_id, r.source] for r in ordered.where("doc_id <> 5").collect()]
    assert at == sorted(at)
    assert mix(docs.limit(0)).count() == 0


def test_given_weights_are_followed_at_every_slot():
    for weights in ([1 / 3] + [2 / 57] * 19, [0.9999, 0.0001], [5.0, 0.3, 1e-7]):
        w = np.array(weights)
        blocks = np.maximum(1, np.floor(w / w.sum() * 30_000)).astype(np.int64) + 1
        plan = schedule(blocks, w)
        slots = [plan.place(i, np.arange(n))[0] for i, n in enumerate(blocks)]
        end = min(int(s[-1]) for s in slots)  # from here on a source has run out
        for s, share in zip(slots, w / w.sum()):
            got = np.searchsorted(s, np.arange(end), "right")
            assert (abs(got - share * np.arange(1, end + 1)) < 1 + 1e-6).all()


def test_two_thousand_sources_with_weights_down_to_a_hundred_thousandth():
    rng = np.random.default_rng(4)
    w = np.concatenate([[0.3, 0.2], np.full(500, 1e-5), rng.uniform(1e-5, 4e-4, 1498)])
    blocks = np.maximum(2, np.floor(w / w.sum() * 60_000)).astype(np.int64) + 1
    plan = schedule(blocks, w)
    slots = [plan.place(i, np.arange(n))[0] for i, n in enumerate(blocks)]
    end = min(int(s[-1]) for s in slots)
    assert end > 2000
    for s, share in zip(slots, w / w.sum()):
        got = np.searchsorted(s, np.arange(end), "right")
        assert (abs(got - share * np.arange(1, end + 1)) < 1 + 1e-6).all()


def fluid(blocks, weights, end=None):
    """What each source has got of a fluid after every slot, by pouring it slot by slot."""
    left, got, out = [Fraction(int(n)) for n in blocks], [Fraction(0)] * len(blocks), []
    for _ in range(int(sum(blocks)) if end is None else end):
        rest = Fraction(1)
        while rest:
            live = [i for i, x in enumerate(left) if x and weights[i]] or [i for i, x in enumerate(left) if x]
            share = {i: Fraction(weights[i]) or Fraction(int(blocks[i])) for i in live}
            whole = sum(share.values())
            step = min([rest, *[left[i] * whole / share[i] for i in live]])
            for i in live:
                left[i] -= step * share[i] / whole
                got[i] += step * share[i] / whole
            rest -= step
        out.append(got[:])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.sampled_from([0.0, 0.5, 1.0, 0.1, 3.7, 1e-3])), min_size=1, max_size=6))
def test_every_prefix_is_within_a_block_of_the_fluid(sources):
    blocks, weights = np.array([b for b, _ in sources]), np.array([w for _, w in sources])
    plan = schedule(blocks, weights)
    owner = {int(t): i for i, n in enumerate(blocks) for t in plan.place(i, np.arange(n))[0]}
    given_ = Counter()
    for t, got in enumerate(fluid(blocks, weights)):
        given_[owner[t]] += 1
        assert all(abs(given_[i] - x) < 1 for i, x in enumerate(got))


@pytest.mark.parametrize("n", [20, 200, 1000])
def test_the_whole_mix_of_many_sources_is_within_a_block(n):
    """Sizes are log-normal and weights their power 0.7: small sources run out first, all the way to the last."""
    rng = np.random.default_rng(n)
    blocks = np.maximum(1, rng.lognormal(3, 1.5, n)).astype(np.int64)
    w = blocks.astype(float) ** 0.7
    plan = schedule(blocks, w)
    total = int(blocks.sum())
    ends = np.argsort(blocks / w)  # T at the ends of sources, in floating point
    v = np.concatenate([[0], (blocks / w)[ends]])
    at = np.array([np.minimum(blocks, w * x).sum() for x in v])
    virtual = np.interp(np.arange(1, total + 1), at, v)
    for i in range(n):
        got = np.searchsorted(plan.place(i, np.arange(blocks[i]))[0], np.arange(total), "right")
        assert (abs(got - np.minimum(blocks[i], w[i] * virtual)) < 1 + 1e-6).all()


def naive(blocks, weights):
    """Owners of the slots: windows from the fluid by definition, earliest deadline first, one slot after the other."""
    poured = [[Fraction(0)] * len(blocks), *fluid(blocks, [Fraction(w) for w in weights])]
    done, owners = [0] * len(blocks), []
    release = [[max(t for t, got in enumerate(poured) if got[i] <= k) for k in range(n)] for i, n in enumerate(blocks)]
    due = [[min(t for t, got in enumerate(poured) if got[i] >= k) for k in range(1, n + 1)] for i, n in enumerate(blocks)]
    for t in range(sum(blocks)):
        ready = [(due[i][done[i]], -(weights[i] or blocks[i]), i) for i in range(len(blocks)) if done[i] < blocks[i] and release[i][done[i]] <= t]
        i = min(ready)[2]
        owners.append(i)
        done[i] += 1
    return owners


def test_documents_stand_where_the_definition_puts_them(spark):
    docs, rows = documents(spark)
    for weights, block in (({"s0": 0.5, "s1": 0.3, "s3": 0.01, None: 0.2}, 300), (None, 1000)):
        got = mix(docs, weights, block=block).withColumn("h", F.xxhash64("doc_id", F.lit("mix"))).collect()
        own = defaultdict(list)
        for r in got:
            own[r.source].append(((r.h >> 33) & (1 << 31) - 1, r.h, r.doc_id, max(1, len(r.text or "")), r.mix_slot, r.mix_at))
        size = {s: sum(d[3] for d in x) for s, x in own.items()}
        w = {s: weights.get(s, 0.0) if weights else size[s] ** 0.7 for s in own}
        order = sorted(own, key=lambda s: (-w[s], s is not None, s or ""))
        owners = naive([-(size[s] // -block) for s in order], [w[s] for s in order])
        for i, s in enumerate(order):
            slots, begin = [t for t, o in enumerate(owners) if o == i], 0
            cells = max(1, -(len(own[s]) // -1024))
            for d in sorted(own[s], key=lambda d: (d[0] / (1 << 31) * cells // 1, d[1:4])):
                assert d[4:] == (slots[begin // block], begin % block), (s, d)
                begin += d[3]


def test_sources_beyond_the_lanes_share_them(spark):
    rows = [(i, "x" * (1 + i % 90), f"h{i % 97}" if i % 3 else "hot") for i in range(6000)] + [(9000 + i, "y" * 10, f"late{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    weights = {"hot": 0.4} | {f"h{i}": 0.6 / 97 for i in range(97)}
    got = mix(docs, weights, block=200, lanes=8, groups=5).orderBy("mix_slot", "mix_at").collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    assert len({(r.mix_slot, r.mix_at) for r in got}) == len(rows) and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    assert all(r.source.startswith("late") for r in got[-20:])
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t)
    total, seen, at = sum(weights.values()), Counter(), 0
    for r in got:  # until a source has run out: within two blocks of its share, but for the slot itself and a document that each of the 18 lanes may hold beyond its block
        n = len(r.text)
        seen[r.source] += n
        at += n
        if seen[r.source] == size[r.source]:
            break
        assert abs(seen[r.source] - weights[r.source] / total * at) < 2 * 200 + 200 + 18 * 90
    assert at > 20_000
