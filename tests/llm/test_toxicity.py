"""Folding, matching with exceptions, learning; held-out accuracy on planted insults."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.llm.langid import fold
from rankloom.llm.toxicity import LOOKALIKES, Lexicon, Matcher, fit, folded, score_toxicity

CALM = [a + b for a in ("river", "stone", "cloud", "paper", "window", "garden", "music", "bread") for b in ("", "s", "let", "side", "yard", "work", "fall")]


def test_folding():
    assert folded("You 1D10T, l0s3r & ѕtupіd!!\nＰathétic $cum") == " you idiot loser stupid pathetic scum "
    assert folded("12 + 30 is 42") == " 12 30 is 42 "
    assert folded("wow!!! $$$ ***") == " wow "
    assert folded(None) == folded("") == folded(" \n") == " "
    assert all(len(a) == len(b) == 1 and not a.isascii() and b.isascii() for a, b in LOOKALIKES.items())


def brute(lexicon, text):
    """Matches by trying every word."""
    f, out = folded(text), []
    spans = [(i, i + len(p)) for p in lexicon.exceptions for i in range(len(f)) if f.startswith(p, i)]
    at = 0
    while (at := f.find(" ", at)) >= 0 and at < len(f) - 1:
        own = [(len(k), w) for k, w in lexicon.weights.items() if f.startswith(k, at)]
        if own:
            top = max(w for _, w in own)
            ends = [at + n for n, w in own if w == top]
            if not any(a <= at and e <= b for a, b in spans for e in ends[:1]):
                out.append(top)
        at += 1
    return sorted(out)


def test_automaton_equals_trying_every_word():
    lexicon = Lexicon({" scum ": 3.0, " idio": 2.0, " idiot ": 4.0, " trash ": 1.5}, frozenset({" trash can ", " the trash "}))
    matcher, rng = Matcher(lexicon), random.Random(1)
    for _ in range(300):
        text = " ".join(rng.choice(["scum", "Idiots", "idiot", "trash", "can", "the", "x", "1diot", "scumbag"]) for _ in range(rng.randrange(12)))
        assert sorted(w for _, _, w in matcher.matches(folded(text))) == brute(lexicon, text)


def corpus(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(900):
        words = [rng.choice(CALM) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["moron", "scum", "scуm" if i % 2 else "m0ron"])
        elif i % 3 == 0:
            k = rng.randrange(1, 59)
            words[k : k + 2] = ["trash", "can"]
        if toxic and i % 2:
            words[5:7] = ["trash", "you"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "moron scum"), (2002, "calm " * 50_000 + "moron scum moron")]
    labels += [(2000, 1), (2001, None), (None, 1), (5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS y", "3 AS half", "'q' AS score").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_learns_words_exceptions_and_scores_held_out_texts(spark):
    docs, labels, truth = corpus(spark)
    lexicon = fit(docs, labels, fold("id", 5) != 0)
    assert {" moron ", " scum "} <= set(lexicon.weights)
    held = {r.doc_id: r for r in score_toxicity(docs, lexicon).collect()}
    wrong = [i for i, r in held.items() if i is not None and i < 900 and r.predicted != truth[i]]
    assert len(held) == 904 and len(wrong) <= 9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held.values())
    assert held[2000].score == held[2001].score and held[2000].predicted == 0 and held[None].predicted == 1
    assert held[2002].score < held[None].score  # normalised by length
    assert score_toxicity(docs.limit(0), lexicon).count() == 0


def test_exception_phrases_are_learnt(spark):
    docs, labels, _ = corpus(spark)
    lexicon = Lexicon({" trash ": 2.0}, frozenset())
    from rankloom.llm.toxicity import _exceptions

    sample = docs.join(labels.withColumnRenamed("toxic", "label"), "doc_id").where("label is not null and text is not null").select(F.col("label").alias("y"), "text")
    assert " trash can " in _exceptions(sample, lexicon.weights)
    assert " trash you " not in _exceptions(sample, lexicon.weights)


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_no_contrast_to_learn_from(spark, toxic):
    docs, labels, _ = corpus(spark)
    labels = labels.where("false") if toxic is None else labels.where(f"toxic = {toxic}")
    lexicon = fit(docs, labels, F.lit(True))
    assert not lexicon.weights and score_toxicity(docs, lexicon).where("score between 0 and 1").count() == 904


def test_matches_and_exceptions_on_a_very_long_text_take_one_pass():
    import time

    m = Matcher(Lexicon({" vile ": 2.0, " vil": 1.0}, frozenset({" not vile ", " so vile ", " vile so "})))
    text = " " + " ".join(["vile", "not vile", "so vile so", "vilest", "word"] * 40_000) + " "
    begin = time.perf_counter()
    got = m.matches(text)
    assert time.perf_counter() - begin < 20
    spans = [(a.start(), a.start() + len(p) - 1) for p in m.lexicon.exceptions for a in __import__("re").finditer(f"(?={p})", text[:4000])]
    want = {a.start() for a in __import__("re").finditer("(?= vil)", text[:3900]) if not any(x <= a.start() and a.start() + (5 if text[a.start() :].startswith(" vile ") else 3) <= y for x, y in spans)}
    assert {a for a, _, _ in got if a < 3890} == {a for a in want if a < 3890}
