"""Toxicity by a weighted lexicon that is matched with an Aho-Corasick automaton.

Texts are folded first: case, compatibility forms, accents, look-alike letters of other scripts, and digits
and signs that stand for letters inside a word. The lexicon (words and word stems), its weights and its
exception phrases are learnt from labelled texts; matches inside an exception phrase don't count. What
is left is normalised by length and turned into a probability.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import materialize, sized

#: Bound of the labelled sample, picked by a hash of the ids. Entries and exceptions are bounded by its evidence alone.
SAMPLE_ROWS = 24_000
#: Fewest toxic texts with an entry; evidence (nats) that it isn't chance; log odds; share of toxic texts among a stem's.
LEAST_TEXTS, EVIDENCE, LOG_ODDS, STEM_SHARE = 3, 13.8, 1.5, 0.95
STEMS = (4, 5, 6)

#: Letters of other scripts that look like Latin ones, and what they look like.
LOOKALIKES = dict(zip("авсԁеһіјкӏмнорԛѕтухуԝгαβεηικνορτυχωᴏɑɡıȷ", "abcdehijklmhopqstyxywrabenikvoptuxwoagij"))
#: Signs and digits that stand for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "£": "l", "+": "t"}
_STAND = str.maketrans(STAND_INS)
_MARKED = re.compile(r"[^\W_]*[0-9@$!|€£+][^\W_0-9@$!|€£+](?:[^\W_]|[@$!|€£+](?=[^\W_]))*|[^\W_]+[0-9]+")
_GAP = re.compile(r"[\W_]+")


def _stand_in(found: re.Match) -> str:
    word = found[0]
    return word.translate(_STAND) if any(c.isalpha() for c in word) else word


def _strip(c: str) -> str:
    plain = unicodedata.normalize("NFKD", c)
    return "".join(x for x in plain if not unicodedata.combining(x))


class _Folding(dict):
    """Character -> its folded form, found on first use."""

    def __missing__(self, code: int) -> str:
        out = self[code] = "".join(LOOKALIKES.get(x, x) for x in _strip(chr(code)).lower())
        return out


_folding = _Folding()


def folded(text: str | None) -> str:
    """Folded words of a text, a space before and after each; the space alone if there is none."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = text.translate(_folding)
    text = _MARKED.sub(_stand_in, text)
    return f" {_GAP.sub(' ', text).strip()} " if text.strip() else " "


@dataclass
class Lexicon:
    """weights: " word " or " stem" -> weight; exceptions: " words " inside which matches don't count; line: how a score comes about."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    line: tuple[float, float, float] = (-8.0, 0.0, 0.0)


class Matcher:
    """A lexicon's automaton."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.automaton = lexicon, None
        patterns: dict[str, tuple[int, float, bool]] = {w: (len(w), x, False) for w, x in lexicon.weights.items()}
        patterns |= {p: (len(p), 0.0, True) for p in lexicon.exceptions}
        if patterns:
            self.automaton = ahocorasick.Automaton()
            for pattern, value in patterns.items():
                self.automaton.add_word(pattern, value)
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, weight) of the entries that count in a folded text; of several in one word the heaviest."""
        if self.automaton is None:
            return []
        found: dict[int, tuple[int, int, float]] = {}
        spared: dict[int, int] = {}  # begin -> last character of the longest exception there
        for last, (n, weight, exception) in self.automaton.iter(text):
            begin = last - n + 1
            if exception:
                spared[begin] = last
            elif begin not in found or found[begin][2] < weight:
                found[begin] = (begin, last, weight)
        if not spared:
            return list(found.values())
        out, reach, spans = [], -1, iter(sorted(spared.items()))
        span = next(spans, None)
        for begin in sorted(found):  # one pass: the farthest end of the exceptions that begin at or before a match
            while span is not None and span[0] <= begin:
                reach, span = max(reach, span[1]), next(spans, None)
            if found[begin][1] > reach:
                out.append(found[begin])
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        """Logarithms of the matches' weight, and of the weight per thousand words."""
        f = folded(text)
        total = sum(w for _, _, w in self.matches(f))
        return float(np.log1p(total)), float(np.log1p(1000 * total / max(50, f.count(" ") - 1)))

    def score(self, text: str | None) -> float:
        a, b, c = self.lexicon.line
        x, y = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -30, 30))))


def evidence(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Nats by which an entry's texts are toxic more often than the share of all texts."""
    n = np.maximum(toxic + clean, 1)
    r = np.clip(toxic / n, 1e-9, 1 - 1e-9)
    return np.where(r > share, n * (r * np.log(r / share) + (1 - r) * np.log((1 - r) / (1 - share))), 0.0)


def choose(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries and weights from how many toxic and clean texts hold each word and stem."""
    if not toxic or not clean or not counts:
        return {}
    keys = sorted(counts)
    a, b = np.array([counts[k] for k in keys], float).T
    odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
    stem = np.array([not k.endswith(" ") for k in keys])
    sure = evidence(a, b, toxic / (toxic + clean))
    good = (a >= LEAST_TEXTS) & (odds >= LOG_ODDS) & (sure >= EVIDENCE) & (~stem | (a >= STEM_SHARE * (a + b)))
    return {keys[i]: round(float(min(odds[i], 8.0)), 6) for i in np.flatnonzero(good).tolist()}


def entries_of(text: str | None) -> set[str]:
    """Words and stems that a text holds, as the lexicon writes them."""
    words = set(folded(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) >= n}


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge; slopes aren't negative, so that more matches never lower a score."""
    z, w = np.column_stack([np.ones(len(x)), x]), np.array([-2.0, 0.0, 0.0])
    free = [0, 1, 2]
    for _ in range(2):
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            zf = z[:, free]
            ridge = np.diag([1e-3 if k == 0 else 0.05 for k in free])
            step = np.linalg.solve((zf * (p * (1 - p) + 1e-9)[:, None]).T @ zf + ridge, zf.T @ (y - p) - ridge @ w[free])
            w[free] += np.clip(step, -2, 2)
        if (w[1:] >= 0).all():
            break
        free = [0, *[k for k in (1, 2) if w[k] >= 0]]
        w = np.where(np.isin([0, 1, 2], free), w, 0.0)
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Lexicon:
    """Learn from a bounded sample of the labelled rows where ``trains`` (over the column ``id``) holds. Null ids, texts and labels teach nothing."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) > 0).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(F.coalesce(trains, F.lit(False)))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    n = known.count()
    slot = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 20))
    picked = known.where(slot < min(1 << 20, (rows << 20) // max(n, 1) + 1)).withColumn("half", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    drawn = materialize(texts.join(sized(picked, min(n, 2 * rows), 32), "id").select("id", "y", "half", "text"), "toxicity-sample")
    sample = _apart(drawn)
    size: Counter = Counter({(r["half"], r["y"]): r["count"] for r in sample.groupBy("half", "y").count().collect()})
    if not size:
        return Lexicon()
    toxic, clean = ({h: size[h, y] for h in (0, 1)} for y in (1, 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for y, half, text in zip(*[batch.column(c).to_pylist() for c in ("y", "half", "text")]):
                seen.update((e, half, y) for e in entries_of(text))
        if seen:
            e, half, y = zip(*seen)
            yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(half, pa.int32()), pa.array(y, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["entry", "half", "y", "n"])

    by = [F.sum(F.when((F.col("half") == h) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)]
    found = sample.mapInArrow(count, "entry string, half int, y int, n long").groupBy("entry").agg(*by)
    odds = (F.expr("n01 + n11 + 0.5") / (sum(toxic.values()) + 1)) / (F.expr("n00 + n10 + 0.5") / (sum(clean.values()) + 1))
    found = found.where(f"n01 + n11 >= {LEAST_TEXTS}").where(odds >= float(np.exp(LOG_ODDS))).collect()

    def entries(halves: tuple[int, ...]) -> dict[str, float]:
        return choose({r["entry"]: tuple(sum(r[f"n{h}{y}"] for h in halves) for y in (1, 0)) for r in found}, sum(toxic[h] for h in halves), sum(clean[h] for h in halves))

    whole = entries((0, 1))
    lexicon = Lexicon(whole, _exceptions(sample, whole))
    apart = [Lexicon(entries((1,)), lexicon.exceptions), Lexicon(entries((0,)), lexicon.exceptions)]  # each half is scored by what the other one taught
    shared = spark.sparkContext.broadcast(apart)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(x) for x in shared.value]
        for batch in batches:
            rows = [(y, *matchers[half].features(text)) for y, half, text in zip(*[batch.column(c).to_pylist() for c in ("y", "half", "text")])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.float64(), pa.float64()))], names=["y", "x0", "x1"])

    # Equal features are counted where they are; most texts have none.
    seen = drawn.mapInArrow(features, "y int, x0 double, x1 double").groupBy("y", "x0", "x1").count().collect()
    x, y = np.array([[r["x0"], r["x1"]] for r in seen]), np.array([r["y"] for r in seen], float)
    often = np.array([r["count"] for r in seen])
    lexicon.line = _line(np.repeat(x, often, 0), np.repeat(y, often))
    return lexicon


def sketch(text: str, seed: int) -> int:
    """Smallest hash of a text's three-word shingles: equal for most near copies."""
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()
    return min((xxh64_intdigest(b" ".join(s), seed) for s in (zip(w, w[1:], w[2:]) if len(w) > 2 else [w])), default=0) - (1 << 63)


def _apart(sample: DataFrame) -> DataFrame:
    """One text of each family of copies, so that their accidental words aren't taken for evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *[pa.array([sketch(t, k) for t in texts], pa.int64()) for k in (1, 2)]], names=["id", "y", "s1", "s2"])

    marked = sample.select("id", "y", "text").mapInArrow(run, "id long, y int, s1 long, s2 long")
    first = marked.groupBy("s1", "y").agg(F.min_by(F.struct("id", "s2"), "id").alias("m")).select("m.id", "m.s2", "y")
    kept = materialize(first.groupBy("s2", "y").agg(F.min("id").alias("id")).select("id"), "toxicity-apart")
    return sample.join(F.broadcast(kept), "id", "left_semi")  # at most the sample's bound of rows


def _exceptions(sample: DataFrame, weights: dict[str, float]) -> frozenset[str]:
    """Entries with a word before or after that mostly stand in clean texts."""
    if not weights:
        return frozenset()
    lexicon = Lexicon(weights)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, seen = Matcher(lexicon), Counter()
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                f = folded(text)
                own = set()
                for begin, _, _ in matcher.matches(f):
                    end = f.index(" ", begin + 1)
                    before, after = f.rfind(" ", 0, begin) if begin else -1, f.find(" ", end + 1)
                    own |= {f[before : end + 1]} if before >= 0 else set()
                    own |= {f[begin : after + 1]} if after >= 0 else set()
                seen.update((p, y) for p in own)
        if seen:
            p, y = zip(*seen)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(y, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["phrase", "y", "n"])

    counted = sample.select("y", "text").mapInArrow(contexts, "phrase string, y int, n long").groupBy("phrase").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean")
    )
    mostly = counted.where(f"clean >= {LEAST_TEXTS} and 4 * toxic <= clean")
    return frozenset(r["phrase"] for r in mostly.collect())


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1), predicted (1 from 0.5 on), terms (entries that count, in order).

    Null and empty texts get the score of a text without matches. Whole texts are read; rows that repeat
    are scored alike; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        a, b, c = matcher.lexicon.line
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                terms, x = [], np.zeros((part.num_rows, 2))
                for k, text in enumerate(part.column("text").to_pylist()):
                    f = folded(text)
                    found = matcher.matches(f)
                    total = sum(w for _, _, w in found)
                    x[k] = np.log1p(total), np.log1p(1000 * total / max(50, f.count(" ") - 1))
                    terms.append([f[s : e + 1].strip() for s, e, _ in sorted(found)])
                score = 1 / (1 + np.exp(-np.clip(a + x @ (b, c), -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(terms, pa.list_(pa.string()))], names=["id", "score", "predicted", "terms"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double, predicted int, terms array<string>").withColumnRenamed("id", id_col)
