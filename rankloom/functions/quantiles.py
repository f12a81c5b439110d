"""Exact quantiles of columns of any size with bounded memory.

A quantile is one or two order statistics. Doubles become whole numbers of the same order; tasks count them by their
leading bits, which tells where the wanted places lie, then by the next bits of those that are left, until few enough
are left to be listed. All columns share a pass, and at most five passes find every place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that are listed at last, and bits by which a pass counts.
LISTED, BITS = 100_000, (16, 12, 12, 12, 12)
_SIGN = np.uint64(1 << 63)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned whole numbers of the same order; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.uint64) ^ _SIGN


def _double(key: int) -> float:
    bits = np.array([key], np.uint64) ^ _SIGN
    signed = bits.view(np.int64)
    return float((signed ^ ((signed >> 63) & np.int64(2**63 - 1))).view(np.float64)[0])


def _counted(rows: DataFrame, asked: list[tuple[int, int, int, int]]) -> list[dict[int, int]]:
    """For each (column, bits that are known, their value, further bits): how many values have which further bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << more, np.int64) if more <= BITS[0] else {} for *_, more in asked]
        for batch in batches:
            keys: dict[int, np.ndarray] = {}
            for own, (column, known, prefix, more) in zip(counts, asked):
                if column not in keys:
                    x = batch.column(column).to_numpy(zero_copy_only=False).astype(float, copy=False)
                    keys[column] = _ordered(x[~np.isnan(x)])
                at = keys[column]
                if known:
                    at = at[at >> np.uint64(64 - known) == np.uint64(prefix)] << np.uint64(known)
                at = (at >> np.uint64(64 - more)).astype(np.int64)
                if more <= BITS[0]:
                    own += np.bincount(at, minlength=len(own))
                else:
                    for v, n in zip(*(v.tolist() for v in np.unique(at, return_counts=True))):
                        own[v] = own.get(v, 0) + n
        found = [own if isinstance(own, dict) else {at: int(own[at]) for at in np.flatnonzero(own).tolist()} for own in counts]
        out = [(i, at, n) for i, own in enumerate(found) for at, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], names=["i", "at", "n"])

    out: list[dict[int, int]] = [{} for _ in asked]
    for r in rows.mapInArrow(run, "i long, at long, n long").groupBy("i", "at").agg(F.sum("n").alias("n")).collect():
        out[r["i"]][r["at"]] = r["n"]
    return out


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], listed: int = LISTED) -> dict[str, float | None]:
    """name -> quantile, for name -> (numeric expression, share); between two values it is interpolated. Nulls and NaN don't count; None without values."""
    names = list(wanted)
    if not names:
        return {}
    rows = df.select(*[F.expr(f"cast({x} AS double)").alias(f"v{i}") for i, (x, _) in enumerate(wanted.values())])
    first = _counted(rows, [(i, 0, 0, BITS[0]) for i in range(len(names))])
    counts = [sum(own.values()) for own in first]
    places = {i: (n - 1) * wanted[names[i]][1] for i, n in enumerate(counts) if n}
    #: (column, place) -> leading bits that are known, their value, smaller values, values with these bits
    open_ = {(i, k): (0, 0, 0, counts[i]) for i, x in places.items() for k in (math.floor(x), math.ceil(x))}
    known: dict[tuple[int, int], float] = {}
    histograms = {(i, 0, 0, BITS[0]): own for i, own in enumerate(first)}
    while open_:
        for key, (bits, prefix, below, inside) in list(open_.items()):
            (own,) = (h for h in histograms if h[:3] == (key[0], bits, prefix))
            for at, n in sorted(histograms[own].items()):
                if key[1] < below + n:
                    break
                below += n
            bits, prefix = bits + own[3], prefix << own[3] | at
            if bits == 64:
                known[key] = _double(prefix)
                del open_[key]
            else:
                open_[key] = (bits, prefix, below, n)
        steps = dict(zip(np.cumsum(BITS).tolist(), BITS[1:]))
        asked = sorted({(key[0], bits, prefix, 64 - bits if inside <= listed else steps[bits]) for key, (bits, prefix, _, inside) in open_.items()})
        histograms = dict(zip(asked, _counted(rows, asked))) if asked else {}
    out: dict[str, float | None] = {n: None for n in names}
    for i, x in places.items():
        a, b = known[i, math.floor(x)], known[i, math.ceil(x)]
        out[names[i]] = a if a == b else a + (b - a) * (x - math.floor(x))
    return out
