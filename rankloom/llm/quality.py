"""Quality of documents by a regularised quadratic discriminant over transformed statistics of their texts.

Each text is read whole, once, and becomes a short vector: lengths as logarithms, shares as arcsines of square roots.
Good and bad documents are Gaussians over these vectors with a mean and a covariance each, which is shrunk towards
a multiple of the identity by as much as the class's number of rows asks for. A score is the difference of the two log
densities (Mahalanobis distances through cached Cholesky factors), turned into a probability by a logistic
line that halves of the labelled rows fit on each other.

All labelled rows teach: a task sums their moments, Spark adds up the sums, and the driver sees one vector and one
matrix a class and half. Of rows with equal vectors (copies) one teaches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import materialize, sized

#: A document is good from this score on.
GOOD = 0.7
STATISTICS = ("words", "word_length", "word_length_spread", "single_characters", "long_words", "capitals", "digits", "marks", "signs", "beyond_ascii",
              "vocabulary", "top_word", "repeated_trigrams", "line_words", "repeated_lines", "entropy", "sentence_words")
#: What short texts are filled up with, so that chance doesn't look like a property: words, letters, and what they are like.
WORDS, REPEATS, LETTERS, TYPICAL_LENGTH, TYPICAL_VARIANCE, TYPICAL_ENTROPY = 8, 30, 40, 5.0, 6.0, 4.2
#: Least variance of a statistic (in units of its spread over all rows) and bound of a density difference.
LEAST_VARIANCE, FAR = 1e-3, 60.0
_kinds = np.array([0 if b >= 128 else 1 if chr(b).isupper() else 2 if chr(b).islower() else 3 if chr(b).isdigit() else 4 if chr(b) in ".,;:?!'\"-()" else 5 if b > 32 and b != 127 else 6 for b in range(256)])


def _share(part: float, whole: float, prior: float) -> float:
    """Arcsine of the square root of a share, as if ``prior`` more had been seen without any part: few words prove little."""
    return math.asin(math.sqrt(min(1.0, max(0.0, part / (whole + prior)))))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of ``STATISTICS``; a null counts as empty."""
    raw = (text or "").encode()
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    high, upper, lower, digits, marks, signs, _ = np.bincount(_kinds, weights=bytes_of, minlength=7).tolist()
    seen = high + upper + lower + digits + marks + signs
    words = raw.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    often = Counter(words)
    trigrams = max(0, n - 2)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = bytes_of[bytes_of > 0] / max(len(raw), 1)
    entropy = -float((share * np.log2(share)).sum())
    mean = (lengths.sum() + WORDS * TYPICAL_LENGTH) / (n + WORDS)
    spread = math.sqrt((((lengths - mean) ** 2).sum() + WORDS * TYPICAL_VARIANCE) / (n + WORDS))
    ends = int(bytes_of[[33, 46, 63]].sum())
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), _share(int((lengths == 1).sum()), n, WORDS), _share(int((lengths > 20).sum()), n, WORDS),
        _share(upper, upper + lower, LETTERS), _share(digits, seen, LETTERS), _share(marks, seen, LETTERS), _share(signs, seen, LETTERS), _share(high, seen, LETTERS),
        math.log(len(often) + WORDS) / math.log(n + WORDS), _share(max(often.values(), default=1) - 1, n, WORDS), _share(trigrams - len(set(zip(words, words[1:], words[2:]))), trigrams, REPEATS),
        math.log1p((n + WORDS) / (len(lines) + 1)), _share(len(lines) - len(set(lines)), len(lines), WORDS), (entropy * len(raw) + TYPICAL_ENTROPY * LETTERS) / (len(raw) + LETTERS), math.log1p((n + WORDS) / (ends + 1)),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) of every row, written once: learning and scoring read it instead of the texts. Other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                x = [statistics(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(run, "id long, x array<double>"), "quality-statistics")


def shrunk(scatter: np.ndarray, n: float) -> np.ndarray:
    """Oracle-approximating shrinkage of a covariance of ``n`` rows towards a multiple of the identity."""
    p = len(scatter)
    trace, square = float(np.trace(scatter)), float((scatter * scatter).sum())
    below = (n + 1 - 2 / p) * (square - trace * trace / p)
    rho = 1.0 if below <= 0 else min(1.0, ((1 - 2 / p) * square + trace * trace) / below)
    return (1 - rho) * scatter + (rho * trace / p) * np.eye(p)


@dataclass
class Gaussian:
    """mean, inverse of the Cholesky factor of the covariance, and half the logarithm of its determinant."""

    mean: np.ndarray
    whiten: np.ndarray
    half_log_det: float

    @staticmethod
    def of(mean: np.ndarray, covariance: np.ndarray) -> Gaussian:
        factor = np.linalg.cholesky(covariance)
        return Gaussian(mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Up to a constant that both classes share."""
        z = (x - self.mean) @ self.whiten.T
        return -0.5 * (z * z).sum(axis=1) - self.half_log_det


def _squash(d: np.ndarray) -> np.ndarray:
    """Differences on a scale that grows like a logarithm far from zero: tails of texts aren't as thin as a Gaussian's."""
    return np.arcsinh(d)


@dataclass
class Discriminant:
    """The two classes over standardised statistics, and the line that makes a probability of their difference."""

    center: np.ndarray
    scale: np.ndarray
    good: Gaussian | None = None
    bad: Gaussian | None = None
    line: tuple[float, float] = (0.0, 1.0)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of good minus that of bad, bounded."""
        if self.good is None or self.bad is None:
            return np.zeros(len(x))
        z = (x - self.center) / self.scale
        return np.clip(self.good.log_density(z) - self.bad.log_density(z), -FAR, FAR)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.line[0] + self.line[1] * _squash(self.difference(x)), -30, 30)))


#: Number of rows, sums and sums of products.
Moments = tuple[float, np.ndarray, np.ndarray]


def _add(*parts: Moments) -> Moments:
    return tuple(sum(x) for x in zip(*parts))


def discriminant(good: Moments, bad: Moments) -> Discriminant:
    """The classes from their moments; without two rows of each there is no difference."""
    n, total, products = _add(good, bad)
    center = total / max(n, 1)
    scale = np.sqrt(np.maximum(np.diag(products) / max(n, 1) - center**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    if min(good[0], bad[0]) < 2:
        return Discriminant(center, scale)

    def gaussian(m: Moments) -> Gaussian:
        mean = m[1] / m[0]
        covariance = (m[2] / m[0] - np.outer(mean, mean)) / np.outer(scale, scale)
        return Gaussian.of((mean - center) / scale, shrunk(covariance, m[0]) + LEAST_VARIANCE * np.eye(len(mean)))

    return Discriminant(center, scale, gaussian(good), gaussian(bad))


def _line(d: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression of labels on differences (as ``_squash`` gives them) with a small ridge, by Newton steps that never raise the loss; the slope isn't negative."""
    z, ridge = np.column_stack([np.ones(len(d)), d]), np.array([1e-3, 1e-2])

    def loss(w: np.ndarray) -> float:
        return float((weight * (np.logaddexp(0, z @ w) - y * (z @ w))).sum() + 0.5 * (ridge * w * w).sum())

    w = np.array([0.0, 1.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
    return float(w[0]), max(float(w[1]), 0.0)


def fit(stats: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Learn from the labelled rows where ``trains`` (over the column ``id``) holds; ``stats`` come from ``document_statistics``. Null ids and labels teach nothing; of an id's labels the highest counts."""
    spark, p = stats.sparkSession, len(STATISTICS)
    known = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) > 0).cast("int").alias("y")).where("id is not null and y is not null")
    known = materialize(known.where(F.coalesce(trains, F.lit(False))).groupBy("id").agg(F.max("y").alias("y")), "quality-labels")
    rows = stats.join(sized(known, known.count(), 32), "id").select("x", "y").distinct()
    rows = materialize(rows.withColumn("half", F.pmod(F.xxhash64("x"), F.lit(2)).cast("int")), "quality-rows")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, kind = _matrix(batch.column("x")), batch.column("half").to_numpy() * 2 + batch.column("y").to_numpy()
            for k in np.unique(kind).tolist():
                own = x[kind == k]
                sums[k] = sums.get(k, 0) + np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["kind", "sums"])

    added = rows.mapInArrow(moments, "kind int, sums array<double>").select("kind", F.posexplode("sums").alias("at", "x")).groupBy("kind", "at").agg(F.sum("x").alias("x"))
    of = np.zeros((4, 1 + p + p * p))
    for r in added.collect():
        of[r["kind"], r["at"]] = r["x"]
    bad0, good0, bad1, good1 = [(m[0], m[1 : p + 1], m[p + 1 :].reshape(p, p)) for m in of]
    model = discriminant(_add(good0, good1), _add(bad0, bad1))
    apart = spark.sparkContext.broadcast([discriminant(good1, bad1), discriminant(good0, bad0)])  # each half is scored by what the other one taught

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, half = _matrix(batch.column("x")), batch.column("half").to_numpy()
            d = np.where(half == 0, *[m.difference(x) for m in apart.value])
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(np.round(d, 1))], names=["y", "d"])

    seen = rows.mapInArrow(differences, "y int, d double").groupBy("y", "d").count().collect()  # at most 2 x 1,201 rows
    if seen:
        y, d, n = (np.array([r[c] for r in seen], float) for c in ("y", "d", "count"))
        model.line = _line(_squash(d), y, n)
    return model


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def score_quality(stats: DataFrame, model: Discriminant, id_col: str = "doc_id", good: float = GOOD) -> DataFrame:
    """Per row of ``document_statistics``: id, score (0 to 1), predicted (1 from ``good`` on), difference of the log densities.

    Null and empty texts get the score of an empty text; rows that repeat are scored alike; an empty table gives an
    empty result. Without labels of both classes all rows get the same score.
    """
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            score = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array((score >= good).astype(np.int32)), pa.array(shared.value.difference(x))], names=["id", "score", "predicted", "difference"])

    return stats.mapInArrow(run, "id long, score double, predicted int, difference double").withColumnRenamed("id", id_col)
