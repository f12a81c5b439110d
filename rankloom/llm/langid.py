"""Language identification by interpolated Kneser-Ney character models.

One model per language predicts the letters of a word and its end from up to ORDER - 1 characters before
them. Discounted probabilities and interpolation weights stand in arrays sorted by the hash of the n-gram, with
an entry for each language that holds it: the model grows with what its languages hold, not with their square. A text gets the language of least cross-entropy per predicted character; one whose
cross-entropy lies beyond what calibration texts of that language show is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import give_back, materialize, sized

ORDER = 5
#: Bounds of the labelled sample: so many training rows of each language on average, picked by a hash of their ids, and of all
#: together (with more languages each gives fewer; every language is learnt).
ROWS_PER_LANGUAGE, ROWS = 1500, 300_000
#: Every CALIBRATE-th row of the sample calibrates and isn't learnt from.
CALIBRATE = 5
#: Words kept with their scores (fewer where a worker also serves other stages), and the longest that is kept.
KEPT_WORDS, KEPT_SHARED, KEPT_CHARS = 400_000, 120_000, 40
#: Scores (of words in languages) that are kept or worked out at a time, at most.
KEPT_SCORES, LOT_SCORES = 16_000_000, 1 << 22
#: Characters by which a text's cross-entropy counts as certain.
SURE = 200
#: Share of genuine texts that may be rejected. The calibration texts beyond QUANTILE tell how fast strangeness thins out
#: (a power law, fitted by their median together with PRIOR_TEXTS texts of the slope PRIOR), which carries their quantile on to RATE.
RATE, QUANTILE, PRIOR, PRIOR_TEXTS = 1e-4, 0.95, 0.3, 20
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BEGIN, _END = "\x02", "\x03"


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    found = _LETTERS.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]  # numerals such as fractions aren't letters


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashes(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each character of all padded words (index n - 1), each character's place in its word, and its word."""
    padded = [_BEGIN + w + _END for w in words]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(p) for p in padded])
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, total, power = [], np.zeros(len(codes), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(1, ORDER + 1):
            shifted = np.concatenate([np.zeros(n - 1, np.uint64), codes[: len(codes) - n + 1]]) if n - 1 < len(codes) else np.zeros(len(codes), np.uint64)
            total = total + shifted * power
            power = power * _BASE
            out.append(_mixed(total + np.uint64(n)))
    return out, place, word


@dataclass
class Table:
    """Values by hash and language: the entries of hashes[i] are languages and values from begins[i] to begins[i + 1]."""

    hashes: np.ndarray
    begins: np.ndarray
    language: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray]]) -> Table:
        """From each language's (hashes, values)."""
        hashes = np.concatenate([h for h, _ in parts])
        language = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(h) for h, _ in parts])
        order = np.lexsort((language, hashes))
        hashes, begins = np.unique(hashes[order], return_index=True)
        return Table(hashes, np.append(begins, len(order)), language[order], np.concatenate([v for _, v in parts])[order])

    def spread(self, wanted: np.ndarray, languages: int, absent: float) -> np.ndarray:
        """(wanted, languages) values, ``absent`` where there is no entry."""
        out = np.full((len(wanted), languages), absent)
        i, hit = _find(self.hashes, wanted)
        row = np.flatnonzero(hit)
        begin, n = self.begins[i[row]], self.begins[i[row] + 1] - self.begins[i[row]]
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[np.repeat(row, n), self.language[at]] = self.value[at]
        return out


@dataclass
class Model:
    """grams[n-1]: discounted probabilities of n-grams; contexts[n-1]: of the n - 1 characters before, the weights of the shorter model."""

    languages: list[str]
    grams: list[Table]
    contexts: list[Table]
    symbols: int
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = np.inf
    sharpness: float = 1.0

    def score(self, words: list[str]) -> np.ndarray:
        """log2 probability of each word's letters and end, by language."""
        hashes, place, word = _hashes(words)
        at = np.flatnonzero(place > 0)
        p = np.full((len(at), len(self.languages)), 1.0 / self.symbols)
        for n in range(1, ORDER + 1):
            fits = place[at] >= n - 1
            own = at[fits]
            before = hashes[n - 2][own - 1] if n > 1 else np.zeros(len(own), np.uint64)
            g = self.contexts[n - 1].spread(before, len(self.languages), 1.0)  # an unseen context leaves all to the shorter model
            p[fits] = self.grams[n - 1].spread(hashes[n - 1][own], len(self.languages), 0.0) + g * p[fits]
        out = np.zeros((len(words), len(self.languages)))
        np.add.at(out, word[at], np.log2(p))
        return out


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return i, table[i] == wanted


def train(counts: dict[str, Counter]) -> Model:
    """Kneser-Ney models from each language's word counts."""
    languages = sorted(counts)
    symbols = len({c for words in counts.values() for w in words for c in w}) + 2  # the end of a word and a character never seen
    per_language = [_discounted(list(counts[x]), np.array(list(counts[x].values()), float)) for x in languages]
    grams, contexts = ([Table.of([own[n][k] for own in per_language]) for n in range(ORDER)] for k in (0, 1))
    return Model(languages, grams, contexts, symbols)


def _discounted(words: list[str], weight: np.ndarray) -> list[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """For each order: ((n-gram hashes, discounted probabilities), (context hashes, weights of the shorter model))."""
    hashes, place, word = _hashes(words)
    out = []
    for n in range(1, ORDER + 1):
        at = np.flatnonzero((place > 0) & (place >= n - 1))
        gram, context = hashes[n - 1][at], hashes[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
        if n == ORDER:
            count = weight[word[at]]
        else:
            # Continuations: an n-gram counts once for each character before it; at a word's begin, where none can be, as often as it occurs.
            inner = place[at] >= n
            longer = hashes[n][at]
            count = np.where(inner, 0.0, weight[word[at]])
            _, first = np.unique(np.where(inner, longer, 0), return_index=True)
            count[first[inner[first]]] = 1.0
        gram, first, back = np.unique(gram, return_index=True, return_inverse=True)
        total = np.bincount(back, count, len(gram))
        context = context[first]
        ones, twos = (total == 1).sum(), (total == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context, back = np.unique(context, return_inverse=True)
        whole, kinds = np.bincount(back, total, len(context)), np.bincount(back, minlength=len(context))
        off = np.minimum(total, discount)
        out.append(((gram, (total - off) / whole[back]), (context, np.bincount(back, off, len(context)) / whole)))
        assert kinds.all()
    return out


class Scorer:
    """Cross-entropies of texts; keeps the scores of words it has seen."""

    def __init__(self, model: Model, kept: int = KEPT_WORDS):
        self.model, self.rows, self.known = model, {}, np.zeros((1024, len(model.languages)), np.float32)
        self.kept, self.lot = min(kept, KEPT_SCORES // len(model.languages)), max(16, min(4096, LOT_SCORES // 16 // len(model.languages)))
        self.used = 0  # rows of the table

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per predicted character by language, and the characters predicted (0: no letter)."""
        counted = [Counter(words_of(t)) for t in texts]
        if self.used > self.kept:
            self.rows, self.used = {}, 0
        new = list({w for c in counted for w in c if w not in self.rows})
        for i in range(0, len(new), self.lot):
            lot = new[i : i + self.lot]
            base, self.used = self.used, self.used + len(lot)
            if base + len(lot) > len(self.known):
                self.known = np.concatenate([self.known, np.zeros((max(len(self.known), len(lot)), self.known.shape[1]), np.float32)])
            self.known[base : base + len(lot)] = self.model.score(lot)
            self.rows.update(zip(lot, range(base, base + len(lot))))
        bits, n = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts))
        for k, c in enumerate(counted):
            if c:
                often = np.fromiter(c.values(), np.float64, len(c))
                bits[k] = -(often @ self.known[[self.rows[w] for w in c]])
                n[k] = often @ np.fromiter((len(w) + 1 for w in c), np.float64, len(c))
        for w in new:
            if len(w) > KEPT_CHARS:  # its row stays unused until the table starts anew
                del self.rows[w]
        return bits / np.maximum(n, 1)[:, None], n

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score 0 to 1, rejected) of each text."""
        m = self.model
        entropy, n = self.cross_entropy(texts)
        best = entropy.argmin(1)
        gap = np.exp2(-m.sharpness * (entropy - entropy.min(1, keepdims=True)))
        sure = 1 / gap.sum(1)
        odd = strangeness(m, entropy, n, best) > m.limit
        return [(m.languages[b], float(s), bool(r)) if k else (UNKNOWN, 0.0, True) for b, s, r, k in zip(best, sure, odd, n)]


def strangeness(m: Model, entropy: np.ndarray, n: np.ndarray, language: np.ndarray) -> np.ndarray:
    """How far a text's cross-entropy lies above the language's mean, in spreads that widen for short texts."""
    if m.mean is None:
        return np.zeros(len(n))
    return (entropy[np.arange(len(n)), language] - m.mean[language]) / (m.spread[language] * np.sqrt(1 + SURE / np.maximum(n, 1)))


def _middle(x: np.ndarray) -> tuple[float, float]:
    """Median, and the spread of a normal distribution with the same median deviation (at least 0.1)."""
    middle = float(np.median(x))
    return middle, max(1.4826 * float(np.median(abs(x - middle))), 0.1)


def rejection_limit(odd: np.ndarray) -> float:
    """The strangeness that a share RATE of texts like these exceeds."""
    x = 1 + np.maximum(odd, 0)
    at = float(np.quantile(x, QUANTILE))
    beyond = np.log(x[x > at] / at)
    own = float(np.median(beyond)) / np.log(2) if len(beyond) else 0.0
    slope = (own * len(beyond) + PRIOR * PRIOR_TEXTS) / (len(beyond) + PRIOR_TEXTS)
    return at * ((1 - QUANTILE) / RATE) ** float(slope) - 1


def calibrate(model: Model, texts: list[str], languages: list[str]) -> None:
    """Sets the rejection limit so that a share RATE of texts like the calibration texts is rejected, and the sharpness of the scores by likelihood.

    Texts that score best in another language than their label's are left out, and medians and a tail's
    slope stand for the others, so single wrong labels or junk among them hardly widen the limit.
    """
    index = {x: i for i, x in enumerate(model.languages)}
    keep = [k for k, x in enumerate(languages) if x in index]
    entropy, n = Scorer(model).cross_entropy([texts[k] for k in keep])
    truth = np.array([index[languages[k]] for k in keep], np.int64)
    good = n > 0
    entropy, n, truth = entropy[good], n[good], truth[good]
    if len(n) and (agreed := entropy.argmin(1) == truth).any():
        entropy, n, truth = entropy[agreed], n[agreed], truth[agreed]
    if not len(n):
        return
    own = entropy[np.arange(len(n)), truth]
    steady = n >= SURE / 2
    use = steady if steady.any() else np.ones(len(n), bool)
    overall = _middle(own[use])
    mean, spread = np.full(len(index), overall[0]), np.full(len(index), overall[1])
    for j in range(len(index)):
        if (mine := use & (truth == j)).sum() >= 5:
            mean[j], spread[j] = _middle(own[mine])
    model.mean, model.spread = mean, spread
    model.limit = rejection_limit(strangeness(model, entropy, n, truth))
    gap = entropy - own[:, None]
    model.sharpness = min((float(np.log2(np.exp2(np.minimum(-s * gap, 500)).sum(1)).mean()), s) for s in (1, 2, 4, 8, 16, 32))[1]


def fit(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model from a bounded sample of the rows where ``trains`` holds and text and label aren't null; None if there is none."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), trains.alias("trains")).where("trains and text is not null and label is not null")
    counts = materialize(rows.groupBy("label").count(), "languages")
    languages = counts.count()
    if not languages:
        return None
    each = max(1, min(per_language, ROWS // languages))
    # A row's share of 2**20 hash values; a language with few rows gives all of them.
    share = counts.select("label", F.least(F.lit(1 << 20), F.floor(F.lit(each << 20) / F.col("count")) + 1).cast("int").alias("share"))
    slot = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language")), F.lit(1 << 20))
    picked = rows.join(sized(share, languages, 128), "label").where(slot < F.col("share")).select("label", "text", (F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("fold")), F.lit(CALIBRATE)) == 0).alias("calibrates"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                found.setdefault(label, Counter()).update(words_of(text))
        out = [(x, w, n) for x, c in found.items() for w, n in c.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["label", "word", "n"])

    learnt: dict[str, Counter] = {}
    for r in picked.where("not calibrates").select("label", "text").mapInArrow(count, "label string, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        learnt.setdefault(r["label"], Counter())[r["word"]] = r["n"]
    if not learnt:  # hardly any rows: learn from them all
        for r in picked.select("label", "text").toLocalIterator():
            learnt.setdefault(r["label"], Counter()).update(words_of(r["text"]))
    learnt = {x: c for x, c in learnt.items() if c}
    if not learnt:
        return None
    model = train(learnt)
    held = picked.where("calibrates").select("label", "text").collect()
    calibrate(model, [r["text"] for r in held], [r["label"] for r in held])
    return model


_scorers: dict[int, Scorer] = {}


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score, rejected.

    ``und`` with score 0, rejected, for texts that are null or without a letter, and for every text where
    there is no model. Whole texts are read; rows that repeat are judged alike; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model is not None and id(model) not in _scorers:
            _scorers.clear()
            _scorers[id(model)] = Scorer(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column("text").to_pylist()
                got = _scorers[id(model)].judge(texts) if model is not None else [(UNKNOWN, 0.0, True)] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c, t) for c, t in zip(zip(*got), (pa.string(), pa.float64(), pa.bool_()))]], names=["id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is rejected; all columns stay as they are and no row is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        scorer = Scorer(shared.value, KEPT_SHARED) if shared.value is not None else None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column(text_col).to_pylist()
                good = [not r for _, _, r in scorer.judge(texts)] if scorer is not None else [False] * len(texts)
                yield part.filter(pa.array(good, pa.bool_()))
        del scorer
        give_back()

    return docs.mapInArrow(run, schema)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
