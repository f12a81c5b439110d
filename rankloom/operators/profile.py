"""One row per ticker with everything that is read from its bars: a single pass over the indicators.

Factors, signals, targets and statistics are projections of ``PROFILE``, so bars are shuffled by ticker once
and every window and aggregate above them is evaluated once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.functions.expr import over, roll, whole
from rankloom.operators.histories import profiled
from rankloom.operators.indicators import CLOSED, INDICATORS, layers, one_order
from rankloom.plans.rel import Rel, Registry
from rankloom.sources.adapters import BARS, QUARTERLY

REG = Registry()


def at(k: int, x: str = "close") -> str:
    """Value k bars before the last one."""
    return f"max(CASE WHEN rd = {k + 1} THEN {x} END)"


def tail(agg: str, x: str, n: int) -> str:
    return f"{agg}(CASE WHEN rd <= {n} THEN {x} END)"


def slope(x: str, n: int) -> str:
    """Least-squares slope of the last n values in percent of their mean."""
    y = f"CASE WHEN rd <= {n} THEN {x} END"
    return f"CASE WHEN count({y}) >= {max(3, n // 2)} THEN 100 * regr_slope({y}, i) / nullif(abs(avg({y})), 0) END"


def latest(x: str) -> str:
    """The last value that isn't null."""
    return f"max_by({x}, CASE WHEN {x} IS NOT NULL THEN date END)"


def _widths_back(q) -> str:
    """Number of a bar's width among its ticker's widths, the last one first."""
    back = f"count(bb_width) {whole()} - {one_order(q, f'count(bb_width) {over()}')} + 1" if q.name == "spark" else "sum(CASE WHEN bb_width IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date DESC)"
    return f"CASE WHEN bb_width IS NOT NULL THEN {back} END"


ROWS = layers(
    "feature_rows",
    INDICATORS,
    {"wr": _widths_back,
     "rm60": roll("max", "close", 60, 30), "below_i": f"max(CASE WHEN close <= sma150 THEN i END) {whole()}", "rel_n": f"count(sma150) {whole()}"},
    {"cur_width": f"max(CASE WHEN wr = 1 THEN bb_width END) {whole()}", "days_above": "CASE WHEN below_i IS NOT NULL THEN n_bars - 1 - below_i ELSE rel_n END"},
)

#: Columns of ``features``.
FEATURE_COLUMNS = {
    "n": "count(close)", "last_date": "max(date)", "price": at(0), **{f"c{k}": at(k) for k in (1, 5, 21, 63, 126, 189, 251, 252)},
    **{f"sma{n}": at(0, f"sma{n}") for n in (20, 50, 150, 200)}, "rsi14": at(0, "rsi14"), "atr14": at(0, "atr14"),
    "lo252": tail("min", "close", 252), "hi252": tail("max", "close", 252), "hi63": tail("max", "close", 63), "all_hi": "max(close)", "hi22": tail("max", "close", 22),
    "hi126": tail("max", "close", 126), "lo126": tail("min", "close", 126),
    "hi30": tail("max", "close", 30), "lo30": tail("min", "close", 30), "mean30": tail("avg", "close", 30),
    "n_width": "count(CASE WHEN wr <= 126 THEN bb_width END)", "width_pct": "avg(CASE WHEN wr <= 126 THEN CASE WHEN bb_width < cur_width THEN 1e0 ELSE 0e0 END END)",
    "n_atr": "count(atr14)", "atr_short": tail("avg", "atr14", 14), "atr_long": tail("avg", "atr14", 90), "atr10_now": tail("avg", "atr14", 10),
    "slope_sma200": slope("sma200", 25), "slope_sma50": slope("sma50", 15), "slope_sma150": slope("sma150", 30), "slope_obv": slope("obv", 40), "slope_close": slope("close", 40),
    "avg_all_but_first": "avg(CASE WHEN rd <= n_bars - 1 THEN close END)", "days_above": "max(days_above)",
    "pre_n": "count(CASE WHEN i >= greatest(0, n_bars - days_above - 200) AND i < n_bars - days_above THEN close END)",
    **{f"pre_{a}": f"{a}(CASE WHEN i >= greatest(0, n_bars - days_above - 200) AND i < n_bars - days_above THEN close END)" for a in ("min", "max", "avg")},
    "n_ret": tail("count", "ret", 120), "win_rate": "avg(CASE WHEN rd <= 120 AND ret IS NOT NULL THEN CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END END)",
    "jump_rate": "avg(CASE WHEN rd <= 120 AND ret IS NOT NULL THEN CASE WHEN abs(ret) > 0.07 THEN 1e0 ELSE 0e0 END END)",
    "n_rm": "count(rm60)", "high_rate": "avg(CASE WHEN rd <= 120 THEN CASE WHEN close >= rm60 * 0.999e0 THEN 1e0 ELSE 0e0 END END)",
    "vol20": tail("avg", "volume", 20), "vol30": tail("avg", "volume", 30), "vol60": tail("avg", "volume", 60),
    "macd_now": at(0, "macd_line - macd_signal"), "macd_before": at(5, "macd_line - macd_signal"),
}
#: Columns of which the signals read the last value.
LAST_COLUMNS = ("close", "rsi14", "raw_k9", "stoch_rsi", "macd_line", "macd_signal", "adx", "plus_di", "minus_di", "williams", "cci", "roc12", "ultimate", "pct_b", "bb_width", "mfi", "donchian", "ichimoku", "atr14", "atr10",
                *(f"{k}{n}" for n in (5, 10, 20, 50, 100, 200) for k in ("sma", "ema")), "sma150")
_LOG = "CASE WHEN rd <= 120 THEN ln(CASE WHEN close > 0 THEN close END) END"
#: Columns of ``tail_stats``.
TAIL_COLUMNS = {
    "trend_r2": f"CASE WHEN count(CASE WHEN rd <= 120 THEN close END) >= 40 AND var_pop({_LOG}) > 0 THEN regr_r2({_LOG}, i) * CASE WHEN regr_slope({_LOG}, i) > 0 THEN 1 ELSE -1 END END",
    "slope40": "CASE WHEN count(CASE WHEN rd <= 40 THEN close END) >= 20 THEN 100 * regr_slope(CASE WHEN rd <= 40 THEN close END, i) / nullif(abs(avg(CASE WHEN rd <= 40 THEN close END)), 0) END",
    "vol252": "CASE WHEN count(CASE WHEN rd <= 252 THEN ret END) > 20 THEN stddev_samp(CASE WHEN rd <= 252 THEN ret END) * sqrt(252e0) END",
    "max_drawdown252": "CASE WHEN count(CASE WHEN rd <= 252 THEN close END) >= 20 THEN min(drawdown) END",
}


def _aroon(q, x: str, key: str) -> str:
    """The last bar's share of 25 bars since the extreme of them, the oldest of equal ones. Spark compares with the extreme: a state that holds a record would make it sort the bars by ticker again and box every figure of them."""
    extreme = f"min(CASE WHEN rd <= 25 AND {key} = extreme_{x} THEN i END)" if q.name == "spark" else f"min_by(i, CASE WHEN rd <= 25 AND {x} IS NOT NULL THEN {q.row(key, 'i')} END)"
    return f"CASE WHEN count(CASE WHEN rd <= 25 THEN {x} END) = 25 THEN 100 * (25 - (max(i) - {extreme})) / 25e0 END"


def _with_extremes(q) -> str:
    if q.name != "spark":
        return "feature_rows"
    return f"(SELECT *, min(CASE WHEN rd <= 25 THEN -high END) {whole()} AS extreme_high, min(CASE WHEN rd <= 25 THEN low END) {whole()} AS extreme_low FROM feature_rows) x"


_WHOLE = ("n", "n_width", "n_atr", "days_above", "pre_n", "n_ret", "n_rm")


def _profiled(closed: DataFrame) -> DataFrame:
    names = ("ticker", *FEATURE_COLUMNS, *(f"last_{c}" for c in LAST_COLUMNS), *TAIL_COLUMNS, "last_aroon_up", "last_aroon_down", "last_supertrend")
    kinds = {"ticker": "string", "last_date": dict(closed.dtypes)["date"]} | dict.fromkeys(_WHOLE, "bigint")
    return profiled(closed, {c: kinds.get(c, "double") for c in names}, LAST_COLUMNS)


#: One row per ticker. Spark numbers and orders the bars and tasks make the columns: windows would carry some 150 of them through every layer. ``STATED`` is the same as one statement, without Supertrend's last direction.
PROFILE = Rel(
    "profile",
    lambda q: "SELECT ticker, " + ", ".join(f"{x} AS {c}" for c, x in FEATURE_COLUMNS.items()) + ", " + ", ".join(f"{latest(c)} AS last_{c}" for c in LAST_COLUMNS)
    + ", " + ", ".join(f"{x} AS {c}" for c, x in TAIL_COLUMNS.items()) + f", {_aroon(q, 'high', '-high')} AS last_aroon_up, {_aroon(q, 'low', 'low')} AS last_aroon_down FROM {_with_extremes(q)} GROUP BY ticker",
    (ROWS,),
    run=_profiled,
    reads=(CLOSED,),
)
STATED = replace(PROFILE, run=None, reads=())
FEATURES = Rel("features", f"SELECT ticker, {', '.join(FEATURE_COLUMNS)} FROM profile", (PROFILE,))
LAST = Rel("last_values", f"SELECT ticker, last_date, n, vol20, vol60, {', '.join(f'last_{c} AS {c}' for c in (*LAST_COLUMNS, 'aroon_up', 'aroon_down'))} FROM profile", (PROFILE,))
TAIL = Rel("tail_stats", f"SELECT ticker, {', '.join(TAIL_COLUMNS)} FROM profile", (PROFILE,))
#: Bars that have an average range, with the bands of Supertrend around their middle.
BANDS = Rel("supertrend_bands", "SELECT ticker, date, close AS c, (high + low) / 2 + 3 * atr10 AS u, (high + low) / 2 - 3 * atr10 AS l FROM indicators WHERE atr10 IS NOT NULL", (INDICATORS,))


def directions(bands: DataFrame, bounds: bool = False, dealt: bool = False) -> DataFrame:
    """Direction of each bar (with ``bounds`` the ratcheted bands after it, too), in one pass over a ticker's bars in order of time: what is held is the state after the last bar.

    The bands ratchet (the upper down while the trend is up, the lower up while it is down) and compare with those
    of the bar before; before the first bar with bands the direction is up. ``dealt``: each ticker's rows already lie
    in one task, as windows by ticker leave them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, way, up, low = object(), 1.0, None, None
        for batch in batches:
            out = []
            for ticker, c, u, l in zip(*[batch.column(k).to_pylist() for k in ("ticker", "c", "u", "l")]):  # noqa: E741
                if ticker != last:
                    last, way, up, low = ticker, 1.0, None, None
                if u is not None and l is not None:
                    before = way
                    if c is not None and c > (u if up is None else up):
                        way = 1.0
                    elif c is not None and c < (l if low is None else low):
                        way = -1.0
                    up = u if up is None or before < 0 else min(u, up)
                    low = l if low is None or before > 0 else max(l, low)
                out.append((way, up, low))
            held = dict(zip(("dir", "up", "low")[: 3 if bounds else 1], zip(*out) if out else ((), (), ())))
            yield pa.RecordBatch.from_arrays([batch.column("ticker"), batch.column("date"), *(pa.array(x, pa.float64()) for x in held.values())], names=["ticker", "date", *held])

    kind = dict(bands.dtypes)["date"]
    own = bands if dealt else bands.repartition("ticker")
    return own.sortWithinPartitions("ticker", "date").mapInArrow(run, f"ticker string, date {kind}, dir double" + (", up double, low double" if bounds else ""))


def _folded(q) -> str:
    """The same as one fold over a list."""
    null, none = "cast(NULL AS double)", q.no_doubles()
    turned = "CASE WHEN b.c > coalesce(s.pu, b.u) THEN 1e0 WHEN b.c < coalesce(s.pl, b.l) THEN -1e0 ELSE s.dir END"
    step = {
        "dir": turned,
        "pu": "CASE WHEN s.pu IS NOT NULL AND s.dir > 0 THEN least(b.u, s.pu) ELSE b.u END",
        "pl": "CASE WHEN s.pl IS NOT NULL AND s.dir < 0 THEN greatest(b.l, s.pl) ELSE b.l END",
        "c": "b.c", "u": "b.u", "l": "b.l", "dirs": f"concat(s.dirs, {q.doubles(turned)})",
    }
    start = {"dir": "1e0", **dict.fromkeys(("pu", "pl", "c", "u", "l"), null), "dirs": none}
    bars = q.collect(q.record(**{k: {"dir": "1e0", "pu": null, "pl": null, "dirs": none}.get(k, k) for k in start}), "date")
    whole = f"SELECT ticker, {q.fold('bars', q.record(**start), q.record(**step))}.dirs AS dirs, dates FROM (SELECT ticker, {bars} AS bars, {q.collect('date', 'date')} AS dates FROM supertrend_bands GROUP BY ticker) x"
    return f"SELECT ticker, {q.side_by_side('dates', 'dirs', 'date', 'dir')} FROM ({whole}) y"


#: Supertrend of every bar that has an average range, and of the last one.
SUPERTREND_SERIES = Rel("supertrend_series", _folded, (BANDS,), run=lambda bands: directions(bands, dealt=True))
SUPERTREND = Rel(
    "supertrend",
    "SELECT s.ticker, s.dir AS supertrend FROM supertrend_series s JOIN profile p ON p.ticker = s.ticker AND p.last_date = s.date",
    (SUPERTREND_SERIES, PROFILE),
    run=lambda profile: profile.where("ticker IS NOT NULL AND last_supertrend IS NOT NULL").selectExpr("ticker", "last_supertrend AS supertrend"),
    reads=(PROFILE,),
)


#: What further queries of a session build on, in the order in which it is computed.
CUTS = REG.cuts = (BARS, QUARTERLY, PROFILE)
REG.rel("in_trend_r_squared", "SELECT ticker, round(trend_r2, 6) AS trend_r2 FROM tail_stats", TAIL)
REG.rel("in_slope_pct", "SELECT ticker, round(slope40, 6) AS slope40 FROM tail_stats", TAIL)
REG.rel("in_annualized_vol", "SELECT ticker, round(vol252, 6) AS vol252 FROM tail_stats", TAIL)
REG.rel("in_max_drawdown", "SELECT ticker, round(max_drawdown252, 6) AS max_drawdown252 FROM tail_stats", TAIL)
REG.rel("in_supertrend", "SELECT ticker, supertrend FROM supertrend", SUPERTREND)
REG.rel("in_supertrend_series", "SELECT ticker, date, dir FROM supertrend_series", SUPERTREND_SERIES)
