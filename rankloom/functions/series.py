"""Bars of several tickers as matrices, a row a ticker and a column a bar: what windows and sums over them need in numpy.

Missing values are NaN, as are the cells after a ticker's last bar. Sums run in order of time, like those of a window.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from rankloom.functions.expr import BLOCK, _blocks_back

#: Cells of a matrix: some 0.5 MB a column.
CELLS = 1 << 16


def histories(batches: Iterator[pa.RecordBatch], rows: int = 4 * CELLS) -> Iterator[pa.Table]:
    """Batches of rows in the order of ticker and time, joined to tables that hold whole tickers, of some ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            last = starts(table)[-1]
            if last:
                yield table.slice(0, last)
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def starts(table: pa.Table) -> np.ndarray:
    """First row of each ticker; null is one, too."""
    code = table.column("ticker").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))


def matrices(table: pa.Table, names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(first rows, lengths, columns) of tickers of like length, some CELLS cells at a time."""
    first = starts(table)
    length = np.diff(np.append(first, table.num_rows))
    flat = {n: np.append(table.column(n).to_numpy().astype(float), np.nan) for n in names}
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * length[order[end]] <= CELLS:
            end += 1
        own = order[at:end]
        own.sort()
        col = np.arange(length[own].max())
        place = np.where(col < length[own][:, None], first[own][:, None] + col, table.num_rows)
        yield first[own], length[own], {n: x[place] for n, x in flat.items()}
        at = end


def lag(x: np.ndarray, k: int = 1) -> np.ndarray:
    out = np.full(x.shape, np.nan)
    out[:, k:] = x[:, : max(0, x.shape[1] - k)]
    return out


def nz(x: np.ndarray) -> np.ndarray:
    """Zero is missing, as a divisor."""
    return np.where(x == 0, np.nan, x)


def counts(x: np.ndarray, n: int | None = None) -> np.ndarray:
    """Values among the last n cells (all without n)."""
    c = np.cumsum(~np.isnan(x), axis=1)
    if n is not None:
        c[:, n:] = c[:, n:] - c[:, :-n].copy()
    return c


def sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sum of the last n cells, from the oldest on."""
    known, out = np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf), np.zeros(x.shape)
    for k in range(min(n, x.shape[1]) - 1, -1, -1):
        out[:, k:] += known[:, : x.shape[1] - k]
    return out


def extremes(x: np.ndarray, n: int, pick) -> np.ndarray:
    """np.fmax or np.fmin of the last n cells."""
    width = 1
    while width < n:
        step = min(width, n - width)
        x, width = pick(x, lag(x, step)), width + step
    return x


def roll(agg: str, x: np.ndarray, n: int, least: int) -> np.ndarray:
    """An aggregate of the last n cells, where ``least`` of them have a value."""
    c = counts(x, n)
    if agg == "max" or agg == "min":
        out = extremes(x, n, np.fmax if agg == "max" else np.fmin)
    elif agg == "sd":  # of a population, in one pass as windows take it: equal values give exactly zero
        seen, mean, square = np.zeros(x.shape), np.zeros(x.shape), np.zeros(x.shape)
        for k in range(min(n, x.shape[1]) - 1, -1, -1):
            v, s, m, q = x[:, : x.shape[1] - k], seen[:, k:], mean[:, k:], square[:, k:]
            ok = ~np.isnan(v)
            s += ok
            delta = np.where(ok, v - m, 0.0)
            part = delta / np.maximum(s, 1)
            m += part
            q += delta * (delta - part)
        out = np.sqrt(square / np.maximum(seen, 1))
    else:
        out = sums(x, n)
        if agg == "avg":
            out = out / np.maximum(c, 1)
    return np.where(c >= least, out, np.nan)


def _carried(inner: np.ndarray, alpha: float) -> np.ndarray:
    """What the blocks before a cell's have left at the end of the last of them, see ``expr.carried``."""
    out, left = np.zeros(inner.shape), BLOCK * math.log(1 - alpha)
    for b in range(1, -(-inner.shape[1] // BLOCK)):
        for k in range(1, min(_blocks_back(alpha), b) + 1):
            out[:, b * BLOCK : (b + 1) * BLOCK] += math.exp(left * (k - 1)) * inner[:, (b - k + 1) * BLOCK - 1][:, None]
    return out


def _by_block(x: np.ndarray) -> np.ndarray:
    """Running sums that begin anew with each block."""
    out = np.empty(x.shape)
    for b in range(0, x.shape[1], BLOCK):
        np.cumsum(x[:, b : b + BLOCK], axis=1, out=out[:, b : b + BLOCK])
    return out


def _known(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0.0, x)


def ewm(x: np.ndarray, alpha: float, least: int, first: np.ndarray | int) -> np.ndarray:
    """Exponentially weighted mean of a series whose ``first`` cell (of all, or of each ticker) weighs one; blocks as in ``expr.ewm_whole``."""
    r, col = math.log(1 - alpha), np.arange(x.shape[1])
    pos = col % BLOCK
    weight = np.where(col == (first if isinstance(first, int) else first[:, None]), 1.0, alpha)
    inner = np.exp(pos * r) * _by_block(_known(weight * x * np.exp(pos * -r)))
    return np.where(counts(x) >= least, inner + np.exp((pos + 1) * r) * _carried(inner, alpha), np.nan)


def ewm_with_gaps(x: np.ndarray, alpha: float, least: int) -> np.ndarray:
    """The same where gaps let the weight of the mean before decay, see ``expr.gap_steps``."""
    r, col = math.log(1 - alpha), np.arange(x.shape[1], dtype=float)
    seen = np.maximum.accumulate(np.where(np.isnan(x), -1.0, col), axis=1)
    before = lag(seen)
    gap = np.where(before >= 0, col - before, np.nan)
    whole = np.exp(gap * r) + alpha
    kept = _by_block(np.where(np.isnan(x) | np.isnan(gap), 0.0, gap * r - np.log(whole)))
    inner = np.exp(kept) * _by_block(_known(np.where(np.isnan(gap), 1.0, alpha / whole) * x * np.exp(-kept)))
    return np.where(counts(x) >= least, inner + np.exp(kept) * _carried(inner, alpha), np.nan)


def mean_of(x: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Mean of each row's known cells among ``where``."""
    ok = where & ~np.isnan(x)
    n = ok.sum(1)
    return np.where(n > 0, np.where(ok, x, 0.0).sum(1) / np.maximum(n, 1), np.nan)


def extreme_of(x: np.ndarray, where: np.ndarray, pick) -> np.ndarray:
    return pick.reduce(np.where(where, x, np.nan), axis=1)


def latest(x: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Each row's last known cell."""
    place = np.where(real & ~np.isnan(x), np.arange(x.shape[1]), -1).max(1)
    return np.where(place >= 0, x[np.arange(len(x)), np.maximum(place, 0)], np.nan)


def fit(y: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, ...]:
    """(number, slope, sum of squares, r squared) of the least-squares line of each row's known cells over their numbers; equal values give exactly zero."""
    ok = where & ~np.isnan(y)
    n = ok.sum(1)
    some = np.maximum(n, 1)
    d = np.where(ok, y - latest(y, where)[:, None], 0.0)
    d = np.where(ok, d - (d.sum(1) / some)[:, None], 0.0)
    col = np.arange(y.shape[1], dtype=float)
    c = np.where(ok, col - (np.where(ok, col, 0.0).sum(1) / some)[:, None], 0.0)
    cross, width, square = (c * d).sum(1), (c * c).sum(1), (d * d).sum(1)
    return n, cross / nz(width), square, cross * cross / nz(width * square)


def quiet(run):
    """NaN stands for null: divisions and comparisons with it are meant."""

    def inner(*args):
        with np.errstate(all="ignore"), warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            return run(*args)

    return inner
