"""Quality classifier: densities and shrinkage against plain formulas, learning on planted junk, edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import quality
from rankloom.llm.langid import fold
from rankloom.llm.quality import STATISTICS, Gaussian, discriminant, document_statistics, fit, score_quality, shrunk, statistics

WORDS = "the river flows under old stone bridges while people walk along its banks and talk about weather music bread gardens".split()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(4, 14))).capitalize() + rng.choice([".", ".", "?", "!"])


def good(rng):
    return "\n".join(" ".join(sentence(rng) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 8)))


def bad(rng):
    kind, text = rng.randrange(4), good(rng)
    if kind == 0:
        return text.upper().replace(" ", "!! ")
    if kind == 1:
        return " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in text.split())
    if kind == 2:
        return " | ".join(text.split())
    return f"{rng.choice(WORDS)} " * rng.randrange(40, 200)


def test_statistics():
    x = dict(zip(STATISTICS, statistics("Ab ab ab ab\nAb ab ab ab\né 12 #")))
    assert x["words"] == pytest.approx(math.log1p(11))
    assert x["top_word"] == pytest.approx(math.asin(math.sqrt(5 / 19)))
    assert x["repeated_trigrams"] == pytest.approx(math.asin(math.sqrt((9 - 7) / 39)))
    assert x["repeated_lines"] == pytest.approx(math.asin(math.sqrt(1 / 11)))
    assert x["beyond_ascii"] == pytest.approx(math.asin(math.sqrt(2 / (21 + 40))))
    assert x["capitals"] == pytest.approx(math.asin(math.sqrt(2 / (16 + 40))))
    for text in (None, "", " \n", "a", "\x00", " ", "x" * 100_000, "日" * 1000, "\n" * 1000):
        assert len(statistics(text)) == len(STATISTICS) and np.isfinite(statistics(text)).all()
    assert statistics(None) == statistics("")


def test_density_and_shrinkage_equal_plain_formulas():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(5, 5))
    covariance, mean, x = a @ a.T + np.eye(5), rng.normal(size=5), rng.normal(size=(7, 5))
    want = [-0.5 * (v - mean) @ np.linalg.inv(covariance) @ (v - mean) - 0.5 * math.log(np.linalg.det(covariance)) for v in x]
    assert np.allclose(Gaussian.of(mean, covariance).log_density(x), want)
    s = shrunk(covariance, 20.0)
    assert np.trace(s) == pytest.approx(np.trace(covariance))
    assert np.linalg.norm(shrunk(covariance, 1e9) - covariance) < 1e-6 < np.linalg.norm(s - covariance) < np.linalg.norm(shrunk(covariance, 3.0) - covariance)
    assert np.allclose(shrunk(np.eye(4), 10.0), np.eye(4))


def planted(spark, n=900):
    rng = random.Random(6)
    docs = [(i, bad(rng) if i % 6 == 0 else good(rng)) for i in range(n)]
    labels = [(i, int((i % 6 != 0) ^ (i % 41 == 7))) for i in range(0, n)]  # some labels are wrong
    docs += [(n + i, docs[6][1]) for i in range(300)] + [(None, "x"), (2 * n, None), (2 * n + 1, ""), (3, docs[3][1])]
    labels += [(n + i, 0) for i in range(300)] + [(None, 0), (5, None), (99999, 1), (4, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = planted(spark)
    stats = document_statistics(docs)
    rows = score_quality(stats, fit(stats, labels, fold("id", 4) != 2)).where(fold("doc_id", 4) == 2).where("doc_id < 900").collect()
    right = [(r["doc_id"] % 6 != 0) == bool(r["predicted"]) for r in rows]
    assert len(rows) > 150 and sum(right) / len(right) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_model_equals_one_fit_over_all_rows(spark):
    docs, labels = planted(spark, 300)
    stats = document_statistics(docs)
    model = fit(stats, labels, F.lit(True))
    known: dict = {}
    for i, y in map(tuple, labels.collect()):
        if i is not None and y is not None:
            known[i] = max(known.get(i, 0), y)
    rows = {(known[i], tuple(x)) for i, x in map(tuple, stats.collect()) if i in known}
    moments = lambda y: (lambda x: (len(x), x.sum(0), x.T @ x))(np.array([v for k, v in rows if k == y]))
    want = discriminant(moments(1), moments(0))
    x = np.array(sorted(v for _, v in rows))
    assert np.allclose(model.difference(x), want.difference(x), atol=1e-6)


def test_labels_of_one_class_and_empty_tables(spark):
    docs, labels = planted(spark, 60)
    stats = document_statistics(docs)
    for own in (labels.where("quality = 1"), labels.limit(0)):
        scores = {r["score"] for r in score_quality(stats, fit(stats, own, F.lit(True))).collect()}
        assert len(scores) == 1
    assert score_quality(document_statistics(docs.limit(0)), fit(stats, labels, F.lit(True))).count() == 0
    clashing = docs.withColumn("x", F.lit(1)).withColumn("id", F.lit(2)).withColumn("y", F.lit(3))
    wide = labels.withColumn("id", F.lit(1)).withColumn("y", F.lit(2)).withColumn("x", F.lit(3))
    again = document_statistics(clashing)
    assert score_quality(again, fit(again, wide, F.lit(True))).count() == docs.count()
    assert quality.GOOD == 0.7
