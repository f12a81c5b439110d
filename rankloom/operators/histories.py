"""The indicators and the profile of whole histories in numpy, as tasks compute them from the bars that Spark has dealt and ordered.

Windows of Spark carry every column of a bar through each of their layers; here a column is a matrix of tickers by bars
and is made once, when it is read. The statements of ``indicators`` and ``profile`` state the same; tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.functions.expr import BLOCK, span
from rankloom.functions.series import counts, ewm, ewm_with_gaps, extreme_of, extremes, fit, histories, lag, latest, matrices, mean_of, nz, quiet, roll

FIGURES = ("open", "high", "low", "close", "volume")


def _series(make):
    return cached_property(make)


class Indicators:
    """Columns of ``indicators`` by name, each a matrix; NaN where they are null."""

    def __init__(self, length: np.ndarray, bars: dict[str, np.ndarray]) -> None:
        self.length, self.high, self.low, self.close, self.volume = length, *(bars[c] for c in FIGURES[1:])
        self.col = np.arange(self.close.shape[1])
        self.rd = length[:, None] - self.col  # 1 is the last bar, cells after it have less
        self.real = self.rd >= 1
        self.pc, self.tp = lag(self.close), (self.high + self.low + self.close) / 3

    def tail(self, n: int) -> np.ndarray:
        return self.real & (self.rd <= n)

    def sma(self, n: int) -> np.ndarray:
        before = lag(self.total, n)
        before[:, :n] = 0
        return np.where(self.col + 1 >= max(2, n // 2), (self.total - before) / np.minimum(self.col + 1, n), np.nan)

    def ema(self, n: int) -> np.ndarray:
        return ewm(self.close, span(n), max(2, n // 2), 0)

    def wilder(self, x: np.ndarray, n: int = 14, first: int = 0) -> np.ndarray:
        return ewm(x, 1 / n, n, first)

    def high_of(self, n: int) -> np.ndarray:
        return roll("max", self.high, n, n // 2)

    def low_of(self, n: int) -> np.ndarray:
        return roll("min", self.low, n, n // 2)

    def _oscillation(self, n: int) -> np.ndarray:
        return roll("sum", self.bp, n, n // 2) / nz(roll("sum", self.tr, n, n // 2))

    total = _series(lambda s: np.cumsum(s.close, axis=1))
    tr = _series(lambda s: np.fmax(np.fmax(s.high - s.low, np.abs(s.high - s.pc)), np.abs(s.low - s.pc)))
    bp = _series(lambda s: s.close - np.fmin(s.low, s.pc))
    ret = _series(lambda s: s.close / nz(s.pc) - 1)
    rises = _series(lambda s: s.high - lag(s.high))
    falls = _series(lambda s: lag(s.low) - s.low)
    atr14 = _series(lambda s: s.wilder(s.tr))
    atr10 = _series(lambda s: s.wilder(s.tr, 10))
    plus_di = _series(lambda s: 100 * s.wilder(np.where((s.rises > s.falls) & (s.rises > 0), s.rises, 0.0)) / nz(s.atr14))
    minus_di = _series(lambda s: 100 * s.wilder(np.where((s.falls > s.rises) & (s.falls > 0), s.falls, 0.0)) / nz(s.atr14))
    dx = _series(lambda s: np.where(s.real, 100 * np.abs(s.plus_di - s.minus_di) / nz(s.plus_di + s.minus_di), np.nan))
    adx = _series(lambda s: ewm_with_gaps(s.dx, 1 / 14, 14))
    macd_line = _series(lambda s: np.where(s.real, s.ema(12) - s.ema(26), np.nan))
    obv = _series(lambda s: np.cumsum(np.nan_to_num(np.sign(s.close - s.pc) * s.volume, nan=0.0, posinf=np.inf, neginf=-np.inf), axis=1))
    sma20 = _series(lambda s: s.sma(20))
    sma150 = _series(lambda s: s.sma(150))
    sd20 = _series(lambda s: roll("sd", s.close, 20, 10))
    bb_upper = _series(lambda s: s.sma20 + 2 * s.sd20)
    bb_lower = _series(lambda s: s.sma20 - 2 * s.sd20)
    bb_width = _series(lambda s: nz(s.bb_upper - s.bb_lower) / nz(s.sma20))
    pct_b = _series(lambda s: (s.close - s.bb_lower) / nz(s.bb_upper - s.bb_lower))
    donchian = _series(lambda s: (s.close - s.low_of(20)) / nz(s.high_of(20) - s.low_of(20)))
    raw_k9 = _series(lambda s: 100 * (s.close - s.low_of(9)) / nz(s.high_of(9) - s.low_of(9)))
    williams = _series(lambda s: -100 * (s.high_of(14) - s.close) / nz(s.high_of(14) - s.low_of(14)))
    roc12 = _series(lambda s: 100 * (s.close / nz(lag(s.close, 12)) - 1))
    ultimate = _series(lambda s: 100 * (4 * s._oscillation(7) + 2 * s._oscillation(14) + s._oscillation(28)) / 7)

    @cached_property
    def macd_signal(self) -> np.ndarray:
        known = ~np.isnan(self.macd_line)
        return ewm(self.macd_line, span(9), 9, np.where(known.any(1), known.argmax(1), -1))

    @cached_property
    def rsi14(self) -> np.ndarray:
        up, down = (np.where(np.isnan(self.pc), np.nan, np.fmax(x, 0.0)) for x in (self.close - self.pc, self.pc - self.close))
        average = self.wilder(down, first=1)
        x = 100 - 100 / (1 + self.wilder(up, first=1) / nz(average))
        return np.where((self.real & ~np.isnan(average)).any(1)[:, None], np.where(np.isnan(x), 50.0, x), np.nan)

    @cached_property
    def stoch_rsi(self) -> np.ndarray:
        low, high = roll("min", self.rsi14, 14, 7), roll("max", self.rsi14, 14, 7)
        return np.where(high > low, np.fmax(0.0, np.fmin(100.0, 100 * (self.rsi14 - low) / (high - low))), np.nan)

    @cached_property
    def cci(self) -> np.ndarray:
        mean = roll("avg", self.tp, 20, 10)
        return (self.tp - mean) / (0.015 * nz(roll("avg", np.abs(self.tp - mean), 20, 10)))

    @cached_property
    def mfi(self) -> np.ndarray:
        before, flow = lag(self.tp), self.tp * self.volume
        up, down = (roll("sum", np.where(x, flow, 0.0), 14, 7) for x in (self.tp > before, self.tp < before))
        return 100 - 100 / (1 + up / nz(down))

    @cached_property
    def ichimoku(self) -> np.ndarray:
        mid9, mid26 = ((self.high_of(n) + self.low_of(n)) / 2 for n in (9, 26))
        mid52 = np.where((counts(self.high, 52) >= 26) & (counts(self.low, 52) >= 26), (extremes(self.high, 52, np.fmax) + extremes(self.low, 52, np.fmin)) / 2, np.nan)
        a, b = lag((mid9 + mid26) / 2, 26), lag(mid52, 26)
        return np.where(np.isnan(a) & np.isnan(b), np.nan, np.where(self.close > np.fmax(a, b), 1.0, np.where(self.close < np.fmin(a, b), -1.0, 0.0)))

    @cached_property
    def supertrend(self) -> np.ndarray:
        """Direction after the last bar, a value a ticker; null where that bar has no average range. As ``profile.directions``, a bar of all tickers at a time."""
        middle = (self.high + self.low) / 2
        above, below = middle + 3 * self.atr10, middle - 3 * self.atr10
        known = self.real & ~np.isnan(above) & ~np.isnan(below)
        way, up, low = np.ones(len(self.length)), np.full(len(self.length), np.nan), np.full(len(self.length), np.nan)
        for k in self.col:
            ok, u, l, c, before = known[:, k], above[:, k], below[:, k], self.close[:, k], way  # noqa: E741
            rise = c > np.where(np.isnan(up), u, up)
            fall = ~rise & (c < np.where(np.isnan(low), l, low))
            way = np.where(ok & rise, 1.0, np.where(ok & fall, -1.0, way))
            up = np.where(ok, np.where(before < 0, u, np.fmin(u, up)), up)
            low = np.where(ok, np.where(before > 0, l, np.fmax(l, low)), low)
        return np.where(np.isnan(self.atr10[np.arange(len(way)), self.length - 1]), np.nan, way)

    def named(self, name: str) -> np.ndarray:
        kind = name.rstrip("0123456789")
        if kind in ("sma", "ema") and name not in ("sma20", "sma150"):
            return getattr(self, kind)(int(name[3:]))
        return getattr(self, name)


def profile(s: Indicators, last_columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Columns of ``profile`` but the ticker and the last date, a value a ticker."""
    n, close, real, row = s.length, s.close, s.real, np.arange(len(s.length))

    def at(k: int, x: np.ndarray) -> np.ndarray:
        return np.where(n > k, x[row, np.maximum(n - 1 - k, 0)], np.nan)

    def slope(x: np.ndarray, k: int, least: int | None = None) -> np.ndarray:
        known, up, _, _ = fit(x, s.tail(k))
        return np.where(known >= (least or max(3, k // 2)), 100 * up / nz(np.abs(mean_of(x, s.tail(k)))), np.nan)

    def share(test: np.ndarray, where: np.ndarray) -> np.ndarray:
        return mean_of(np.where(test, 1.0, 0.0), where)

    def number(x: np.ndarray, where: np.ndarray) -> np.ndarray:
        return (where & ~np.isnan(x)).sum(1)

    out: dict[str, np.ndarray] = {"n": n, "price": at(0, close), **{f"c{k}": at(k, close) for k in (1, 5, 21, 63, 126, 189, 251, 252)}}
    sma = {k: s.named(f"sma{k}") for k in (20, 50, 150, 200)}
    out |= {f"sma{k}": at(0, x) for k, x in sma.items()} | {"rsi14": at(0, s.rsi14), "atr14": at(0, s.atr14), "all_hi": extreme_of(close, real, np.fmax)}
    out |= {f"hi{k}": extreme_of(close, s.tail(k), np.fmax) for k in (252, 63, 22, 126, 30)} | {f"lo{k}": extreme_of(close, s.tail(k), np.fmin) for k in (252, 126, 30)}
    out["mean30"] = mean_of(close, s.tail(30))
    width = real & ~np.isnan(s.bb_width)
    few = width & (np.cumsum(width[:, ::-1], axis=1)[:, ::-1] <= 126)
    out |= {"n_width": few.sum(1), "width_pct": share(s.bb_width < latest(s.bb_width, real)[:, None], few)}
    out |= {"n_atr": number(s.atr14, real), "atr_short": mean_of(s.atr14, s.tail(14)), "atr_long": mean_of(s.atr14, s.tail(90)), "atr10_now": mean_of(s.atr14, s.tail(10))}
    out |= {"slope_sma200": slope(sma[200], 25), "slope_sma50": slope(sma[50], 15), "slope_sma150": slope(sma[150], 30), "slope_obv": slope(s.obv, 40), "slope_close": slope(close, 40)}
    out["avg_all_but_first"] = mean_of(close, s.tail(1 << 60) & (s.col > 0))
    below = np.where(real & (close <= sma[150]), s.col, -1).max(1)
    above = np.where(below >= 0, n - 1 - below, number(sma[150], real))
    before = (s.col >= np.maximum(0, n - above - 200)[:, None]) & (s.col < (n - above)[:, None])
    out |= {"days_above": above, "pre_n": number(close, before), "pre_min": extreme_of(close, before, np.fmin), "pre_max": extreme_of(close, before, np.fmax), "pre_avg": mean_of(close, before)}
    moved = s.tail(120) & ~np.isnan(s.ret)
    out |= {"n_ret": moved.sum(1), "win_rate": share(s.ret > 0, moved), "jump_rate": share(np.abs(s.ret) > 0.07, moved)}
    top = roll("max", close, 60, 30)
    out |= {"n_rm": number(top, real), "high_rate": share(close >= top * 0.999, s.tail(120))}
    out |= {f"vol{k}": mean_of(s.volume, s.tail(k)) for k in (20, 30, 60)}
    out |= {"macd_now": at(0, s.macd_line - s.macd_signal), "macd_before": at(5, s.macd_line - s.macd_signal)}
    out |= {f"last_{c}": latest(sma[int(c[3:])] if c.startswith("sma") and int(c[3:]) in sma else s.named(c), real) for c in last_columns}
    log = np.log(np.where(close > 0, close, np.nan))
    _, up, square, share_explained = fit(log, s.tail(120))
    out["trend_r2"] = np.where((number(close, s.tail(120)) >= 40) & (square > 0), share_explained * np.where(up > 0, 1, -1), np.nan)
    out["slope40"] = slope(close, 40, 20)
    year = s.tail(252)
    known = number(s.ret, year)
    off = np.where(year & ~np.isnan(s.ret), s.ret - mean_of(s.ret, year)[:, None], 0.0)
    out["vol252"] = np.where(known > 20, np.sqrt((off * off).sum(1) / np.maximum(known - 1, 1)) * np.sqrt(252), np.nan)
    peak = np.fmax.accumulate(np.where(year, close, np.nan), axis=1)
    out["max_drawdown252"] = np.where(number(close, year) >= 20, extreme_of(close / nz(peak) - 1, year, np.fmin), np.nan)
    for name, x in (("up", -s.high), ("down", s.low)):
        month = s.tail(25) & ~np.isnan(x)
        oldest = (month & (x == extreme_of(x, month, np.fmin)[:, None])).argmax(1)
        out[f"last_aroon_{name}"] = np.where(month.sum(1) == 25, 100 * (25 - (n - 1 - oldest)) / 25, np.nan)
    return out | {"last_supertrend": s.supertrend}


def ordered(closed: DataFrame, *more: str) -> DataFrame:
    """Numbered bars of each ticker, which lie in one task, in the order of windows over numbered bars."""
    rows = closed.selectExpr("ticker", "date", "rn", f"cast(floor(rn / {BLOCK}e0) AS bigint) AS blk", *(f"cast({c} AS double) AS {c}" for c in FIGURES), *more)
    return rows.sortWithinPartitions("ticker", "blk", "date").select("ticker", "date", *FIGURES, *more)


def profiled(closed: DataFrame, columns: dict[str, str], last_columns: tuple[str, ...]) -> DataFrame:
    """A row a ticker, from bars with a close and their numbers. ``columns``: name -> type of the result."""

    @quiet
    def rows(table: pa.Table) -> list[pa.RecordBatch]:
        out = []
        for first, length, bars in matrices(table, FIGURES):
            found = profile(Indicators(length, bars), last_columns)
            keys = {"ticker": table.column("ticker").take(pa.array(first)), "last_date": table.column("date").take(pa.array(first + length - 1))}
            own = [keys[c].combine_chunks() if c in keys else pa.array(found[c], pa.int64()) if kind == "bigint" else pa.array(found[c].astype(float), pa.float64(), from_pandas=True) for c, kind in columns.items()]
            out.append(pa.RecordBatch.from_arrays(own, names=list(columns)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in histories(batches):
            yield from rows(table)

    return ordered(closed).mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in columns.items()))


#: Columns that snapshots take of a bar: indicators, changes over bars, volume against its mean, the return over later bars.
MARKS = ("rsi14", "pct_b", "adx", "donchian", "roc12", "mom21", "mom63", "vol_ratio", "forward")


def marked(numbered: DataFrame, horizon: int) -> DataFrame:
    """Bars of numbered days with MARKS and the day of the ticker's next bar (g_next), from bars with a close, their numbers and those of their days (g)."""
    kind = dict(numbered.dtypes)["date"]

    @quiet
    def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for first, length, bars in matrices(table, (*FIGURES, "g")):
            s, dated = Indicators(length, bars), ~np.isnan(bars["g"])  # bars without a day come first and count for the indicators only
            close = np.where(dated, s.close, np.nan)
            before = lambda k: s.close / nz(lag(close, k)) - 1
            ahead, later = np.full(s.close.shape, np.nan), np.full(s.close.shape, np.nan)
            ahead[:, :-horizon] = s.close[:, horizon:]
            later[:, :-1] = bars["g"][:, 1:]
            made = {"mom21": before(21), "mom63": before(63), "vol_ratio": s.volume / nz(roll("avg", np.where(dated, s.volume, np.nan), 20, 1)), "forward": ahead / nz(s.close) - 1}
            real = s.real & dated
            own = pa.array((first[:, None] + s.col)[real])
            whole = lambda x: pa.array(np.where(np.isnan(x), -1, x).astype(np.int64), mask=np.isnan(x))
            columns = [table.column("ticker").take(own).combine_chunks(), table.column("date").take(own).combine_chunks(), pa.array(s.close[real]), whole(bars["g"][real]), whole(later[real])]
            columns += [pa.array((made[c] if c in made else s.named(c))[real], pa.float64(), from_pandas=True) for c in MARKS]
            yield pa.RecordBatch.from_arrays(columns, names=["ticker", "date", "close", "g", "g_next", *MARKS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in histories(batches):
            yield from rows(table)

    return ordered(numbered, "g").mapInArrow(run, f"ticker string, date {kind}, close double, g bigint, g_next bigint, " + ", ".join(f"{c} double" for c in MARKS))
