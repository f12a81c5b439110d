"""SimHash: keys meet for every pair within two bits; components equal brute force."""

import random

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

from rankloom.llm.components import Forest, connected_components
from rankloom.llm.simhash import ERRORS, _Block, codeword_indices, drop_near_copies, fingerprint, keys, link_fingerprints, odd_sketches, parts_and_sketch, similar_pairs, similarity, simhash_groups


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, at = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [at] * bool(at)
            at = ""
        else:
            at += c
    if not words:
        return "0" * 16
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return f"{sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)):016x}"


def test_segments_one_bit_apart_share_an_index():
    x = np.random.default_rng(3).integers(0, 1 << 23, 4000).astype(np.uint32)
    for bit in range(23):
        y = x ^ np.uint32(1 << bit)
        (ax, ix), (ay, iy) = codeword_indices(x), codeword_indices(y)
        sx, sy = set(zip(ax.tolist(), ix.tolist())), set(zip(ay.tolist(), iy.tolist()))
        assert {a for a, _ in sx & sy} == set(range(len(x)))


def test_keys_meet_within_two_bits():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * 2 + 1
    a, b = rng.integers(0, 64, (2, 3000)).astype(np.uint64)
    y = x ^ (np.uint64(1) << a) ^ (np.uint64(1) << b)
    (ax, kx), (ay, ky) = keys(x), keys(y)
    assert {i for i, _ in set(zip(ax.tolist(), kx.tolist())) & set(zip(ay.tolist(), ky.tolist()))} == set(range(3000))


def components(values):
    f = Forest()
    for i, (rep, fp) in enumerate(values):
        for rep2, fp2 in values[:i]:
            if (fp ^ fp2).bit_count() <= 2:
                f.union(rep, rep2)
    return {rep: f.find(rep) for rep, _ in values}


def test_links_equal_brute_force_with_dense_families(spark):
    rng, values = random.Random(7), set()
    for _ in range(3):  # families dense enough for large buckets
        centre = rng.getrandbits(63)
        values |= {centre ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(20)) for _ in range(400)}
    values |= {rng.getrandbits(63) for _ in range(300)}
    values = list(enumerate(sorted(values)))
    df = spark.createDataFrame([(fp, rep) for rep, fp in values], "fp long, rep long")
    found = {r.node: r.component for r in connected_components(link_fingerprints(df)).collect()}
    want = components(values)
    assert {rep: found.get(rep, rep) for rep, _ in values} == want


def test_chain_and_hub_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(1000, 1200)] + [(7, 7), (160, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert all(got[i] == 3 for i in range(100, 161)) and all(got[i] == 5 for i in range(1000, 1200)) and len(got) == 261


def test_documents(spark):
    base = "one two three four five six seven eight nine ten " * 30
    texts = ["A b\tC", "a B c", "", None, " \n", "x", base, base + "extra", "Ünï Ç d e", "long " * 50_000, base]
    rows = list(enumerate(texts, 10)) + [(None, "x"), (10, "A b\tC")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS rep", "3 AS salt").repartition(3)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(df).collect()]
    assert len(got) == len(rows)
    want = components([(i, int(brute_print(t), 16)) for i, t in enumerate(texts, 10)])
    for i, fp, c in got:
        if i is not None:
            assert fp == brute_print(texts[i - 10]) and c == want[i]
    assert simhash_groups(df.limit(0)).count() == 0
    kept = drop_near_copies(df.where("doc_id is not null"))
    assert kept.columns == df.columns and {10, 12, 15}.issubset({r.doc_id for r in kept.collect()})
    assert fingerprint("A b c") == fingerprint("a\n B  C ")


def test_near_copies_are_dropped_and_others_stay(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(120))  # stands in many documents that are no copies
    rows, copies = [], set()
    for k in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((12, 40, 200, 900)))]
        rows.append((10 * k, " ".join(words) + ("\n" + passage if k % 3 == 0 and len(words) > 300 else "")))
        for c in range(1, 4 if k % 4 == 0 else 1):
            edited = rows[-1 if c == 1 else -c][1].split(" ")
            for _ in range(max(1, len(edited) // 90) if len(edited) > 30 else 0):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((10 * k + c, " ".join(edited)))
            copies.add(10 * k + c)

    def jaccard(x, y):
        a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (x, y))
        return len(a & b) / len(a | b)

    text = dict(rows)
    due = {i for i in copies if jaccard(text[i], text[i - i % 10]) >= 0.85}
    kept = {r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(due) > 40 and len(due & kept) <= 0.03 * len(due)
    assert {i for i in text if i % 10 == 0} <= kept


def test_sketches():
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(5, 60))
    (_, x), (_, y) = parts_and_sketch(a), parts_and_sketch(b)
    assert similarity(x, y) == 51 / 56 and similarity(x, x) == 1
    assert parts_and_sketch(None) == ([], b"") and len(parts_and_sketch("one")[0]) == 1


def star(rng, n_words, n, edits):
    """An original and variants that are edited independently, each at 0.8 or more to it."""
    original = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    out = [" ".join(original)]
    for _ in range(n):
        words = original[:]
        for at in rng.sample(range(5, n_words - 5), edits):
            words[at] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def exact(x, y, words=5):
    a, b = ({tuple(t.split()[i : i + words]) for i in range(len(t.split()) - words + 1)} for t in (x, y))
    return len(a & b) / len(a | b)


def test_large_star_families_are_joined_whole(spark):
    rng = random.Random(17)
    families = [star(rng, 120, 700, 2), star(rng, 300, 500, 6)]
    texts = [t for f in families for t in f]
    assert all(exact(f[0], t) >= 0.8 for f in families for t in f)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in drop_near_copies(docs).collect()} == {0, len(families[0])}
    links = similar_pairs(docs, block=150)  # several blocks: hubs, and what is outside the largest component
    assert len({r.node for r in connected_components(links).collect()}) == len(texts) - 2


def test_documents_that_share_a_passage_are_no_copies_but_their_copies_are(spark):
    rng = random.Random(23)
    passage = " ".join(f"p{i}" for i in range(150))
    rows = []
    for k in range(240):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((10, 60, 250)))]
        rows.append((10 * k, passage + " " + " ".join(words)))
        if k % 5 == 0:
            words[rng.randrange(len(words))] = "edited"
            rows.append((10 * k + 1, passage + " " + " ".join(words)))
    text, want = dict(rows), Forest()
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    for i in text:  # brute force
        for j in text:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want.union(i, j)
    for block in (8192, 100):
        got = Forest()
        for r in similar_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block=block).collect():
            got.union(r.a, r.b)
            assert exact(text[r.a], text[r.b]) >= 0.8
        assert {i: got.find(i) for i in text} == {i: want.find(i) for i in text}


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(8)
    for n in (30, 800, 3000, 20_000):
        for shared in (0.5, 0.75, 0.89, 0.97):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(shared * n)], rng.integers(0, 1 << 63, n - int(shared * n)).astype(np.uint64)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            rows = [(len(x), (o := odd_sketches(x))[0], *o[1], *o[2], x.tobytes()) for x in (a, b)]
            table = pa.table([[0, 1], *map(list, zip(*rows)), [0, 1]], names=["doc_id", "n", "level", "n0", "n1", "odd0", "odd1", "hashes", "component"])
            near, error = _Block(table).estimates(0, np.array([1]))
            assert _Block(table).exact(0, 1) == true
            if true >= 0.7:
                assert abs(near[0] - true) < ERRORS * error[0] < 0.09
            else:
                assert near[0] - ERRORS * error[0] < 0.8


def test_pairs_are_verified_on_whole_texts(spark):
    rng, rows = random.Random(19), []
    for k in range(200):  # pairs of 600 words close to the limit, on both sides of it
        original = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        edited = original[:]
        for at in range(5, 5 + 5 * (11 + k % 5), 5):
            edited[at] = f"w{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(original)), (2 * k + 1, " ".join(edited))]
    text = dict(rows)
    due = {(i, i + 1) for i in range(0, 400, 2) if exact(text[i], text[i + 1]) >= 0.8}
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in similar_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert 20 < len(due) < 180 and got == due
