"""Kneser-Ney models against a plain statement of the recurrence; whole texts, nulls, rejection, held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import langid
from rankloom.llm.langid import LOT_SCORES, Scorer, fit, fold, identify, train, words_of

EN = "the cat sat on the mat and the dog ran to the house with that other thing".split()
DE = "der hund und die katze liegen auf der matte mit dem anderen ding im haus".split()


def plain(words, symbols):
    """Interpolated Kneser-Ney over padded words, written out."""
    padded = {"\2" + w + "\3": n for w, n in words.items()}
    counts = {}
    for n in range(1, langid.ORDER + 1):
        raw, before = Counter(), defaultdict(set)
        for p, times in padded.items():
            for i in range(max(n - 1, 1), len(p)):
                g = p[i - n + 1 : i + 1]
                raw[g] += times
                if i >= n:
                    before[g].add(p[i - n])
        at_begin = Counter()
        for p, times in padded.items():
            if n - 1 >= 1 and len(p) >= n:
                at_begin[p[:n]] += times
        counts[n] = raw if n == langid.ORDER else {g: len(before[g]) + at_begin[g] for g in raw}
    out = {}
    for n, c in counts.items():
        ones, twos = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        whole, off = Counter(), Counter()
        for g, x in c.items():
            whole[g[:-1]] += x
            off[g[:-1]] += min(x, d)
        out[n] = (c, d, whole, off)

    def p(history, ch):
        value = 1 / symbols
        for n in range(1, min(langid.ORDER, len(history) + 1) + 1):
            ctx = history[len(history) - n + 1 :]
            c, d, whole, off = out[n]
            if ctx in whole:
                x = c.get(ctx + ch, 0)
                value = (x - min(x, d)) / whole[ctx] + off[ctx] / whole[ctx] * value
        return value

    def bits(word):
        w = "\2" + word + "\3"
        return sum(math.log2(p(w[:i], w[i])) for i in range(1, len(w)))

    return bits


def test_scores_equal_the_plain_recurrence():
    counts = {"en": Counter(EN), "de": Counter(DE)}
    m = train(counts)
    probe = ["the", "hund", "x", "thing", "katzen", "ünknown", "a" * 50]
    got = m.score(probe)
    for j, lang in enumerate(m.languages):
        bits = plain(counts[lang], m.symbols)
        for i, w in enumerate(probe):
            assert got[i, j] == pytest.approx(bits(w), rel=1e-9)


def test_words():
    assert words_of("Hello, WORLD_9x ½ don't") == ["hello", "world", "x", "don", "t"]
    assert words_of(None) == [] and words_of("12 ½ !") == []


def corpus(spark):
    rows = [(i, " ".join((EN if i % 2 else DE)[k % 15] for k in range(i, i + 40)), "en" if i % 2 else "de") for i in range(120)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 !", None), (1003, "hund und katze " * 20_000, None), (1004, "qxzj wvkq zzxqj qqkx jjzx " * 80, None), (None, "the cat", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "'x' AS label").repartition(3)


def test_identify(spark):
    docs = corpus(spark)
    model = fit(docs, F.coalesce(fold("doc_id", 3) != 1, F.lit(False)))
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and not got[i].rejected for i in range(120))
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "de" and got[None].lang_pred == "en"
    assert got[1004].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    again = identify(docs.drop("lang").withColumn("lang", F.lit("zz")), model)
    assert {r.doc_id: (r.lang_pred, r.score) for r in again.collect()} == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_nothing_to_learn_from(spark):
    docs = corpus(spark)
    assert fit(docs.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in identify(docs, None).collect()} == {"und"}
    assert identify(docs.limit(0), None).count() == 0
    assert fit(docs.where("doc_id = 5"), F.lit(True)).languages == ["en"]


def test_long_words_leave_the_scores_of_others():
    m = train({"en": Counter(EN), "de": Counter(DE)})
    kept, long = langid.Scorer(m), ["a" * 50, "b" * 60, "katze" * 10]
    for k in range(30):
        texts = [" ".join(long), " ".join(EN[: k % 15]) + f" {'xyzuvw'[k % 6] * (k % 9 + 1)}", " ".join(DE[k % 7 :])]
        got, fresh = kept.cross_entropy(texts)[0], langid.Scorer(m).cross_entropy(texts)[0]
        assert got == pytest.approx(fresh, rel=1e-6)
    assert not any(len(w) > langid.KEPT_CHARS for w in kept.rows)


def test_junk_is_rejected_with_noisy_labels(spark):
    import random

    rng, rows = random.Random(3), []
    for i in range(1500):
        text = " ".join(rng.choice(EN if i % 2 else DE) for _ in range(60))
        rows.append((i, text, ("en" if i % 2 else "de") if i % 20 else "en"))  # half of each 20th has a wrong label
    for i in range(2000, 2040):  # junk with a label, also among the calibration rows
        rows.append((i, " ".join("".join(rng.choice("qxzjkvwy") for _ in range(rng.randrange(3, 9))) for _ in range(60)), "en" if i % 2 else "de"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r.rejected for r in identify(docs, fit(docs, F.lit(True))).collect()}
    assert [sum(got[i] for i in got if i >= 2000), sum(got[i] for i in got if i < 2000)] == [40, 0]


def test_two_hundred_languages_cost_what_they_hold():
    import pickle

    rng = random.Random(9)
    counts = {f"l{k:03d}": Counter({"".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 10))): rng.randrange(1, 9) for _ in range(500)}) for k in range(200) for alphabet in ["".join(rng.sample("abcdefghijklmnopqrstuvwxyzäöüéñç", 14))]}
    m, few = train(counts), train({x: counts[x] for x in ("l003", "l150")})
    assert len(pickle.dumps(m)) < 1.2 * 100 * len(pickle.dumps(few))  # linear in the languages
    few.symbols = m.symbols
    words = [*list(counts["l003"])[:40], *list(counts["l150"])[:40], "zzz"]
    assert np.allclose(m.score(words)[:, [3, 150]], few.score(words))
    scorer = Scorer(m)
    assert scorer.lot * len(m.languages) <= LOT_SCORES
    assert all(m.languages[scorer.cross_entropy([" ".join(list(counts[x])[:30])])[0].argmin()] == x for x in ("l003", "l077", "l199"))


def test_every_language_is_learnt(spark, monkeypatch):
    from rankloom.llm import langid

    monkeypatch.setattr(langid, "ROWS", 40)
    rows = [(i, f"{'abcdefgh'[i % 8] * 3} {'ijklmnop'[i % 8] * 2}", f"x{i % 8}") for i in range(400)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == [f"x{k}" for k in range(8)]
