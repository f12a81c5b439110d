"""Indicators carried from day to day: a day's run reads a state row per ticker and the day's bars, not the histories.

The state of a ticker holds the weighted means and their counts, the balance volume, the bands of Supertrend, and rings
(newest first) of the last values that windows reach back to, 253 closes at most. ``begin`` makes it from whole
histories in one pass, ``advance`` adds one day. ``DailyState`` keeps a version a day, in buckets of the ticker, so that
only the day's bars are shuffled; a version is in place once its manifest is, so a day that died is run again.

A state's values are those that ``INDICATORS`` gives for the last bar of the history up to it. Rows without a close are
no bars; a bar that isn't later than its ticker's state is ignored (running a day again changes nothing), of several
bars of a ticker and day the one of greatest values counts; a ticker without a bar keeps its row; a new one starts.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.expr import carried, d, ewm_whole, gap_since, over
from rankloom.operators import indicators
from rankloom.operators.indicators import AROON, BASE, EMA, MA, layers
from rankloom.operators.profile import BANDS, SUPERTREND_SERIES, directions
from rankloom.plans.rel import Rel, Registry, kept, written
from rankloom.sources import layout
from rankloom.sources.adapters import BARS
from rankloom.sources.snapshots import Conflict, SnapshotStore

REG = Registry((BARS,))

#: Name -> (series, the first value's condition on the row's number, alpha, least values).
MEANS = {k: (x, f"rn = {first[-1]}", alpha, least) for k, (x, first, alpha, least) in (indicators._MEANS | indicators._WILDER).items()}
#: Name -> (series, length) of the rings.
RINGS = {"r_close": ("close", 253), "r_high": ("high", 78), "r_low": ("low", 78), "r_tr": ("tr", 28), "r_bp": ("bp", 28), "r_tp": ("tp", 20), "r_dev": ("tp_dev", 20), "r_raw": ("raw_k14", 3), "r_k": ("stoch_k", 3),
         "r_rsi": ("coalesce(rsi14, 50e0)", 14), "r_up": ("flow_up", 14), "r_down": ("flow_down", 14), "r_mid": ("(mid9 + mid26) / 2", 27), "r_mid52": ("mid52", 27)}
#: What users read of a state.
SHOWN = (*(f"sma{n}" for n in MA), *(f"ema{n}" for n in EMA), "rsi14", "tr", "atr14", "atr10", "obv", "macd_line", "macd_signal", "macd_hist", "plus_di", "minus_di", "adx", "stoch_k", "stoch_d", "stoch_rsi",
         "williams", "cci", "roc12", "ultimate", "bb_upper", "bb_lower", "pct_b", "bb_width", "mfi", "donchian", "ichimoku", "aroon_up", "aroon_down", "supertrend", "max_drawdown252", "vol252")
_HELD = ("date", "rn", "close", "high", "low", "tp", *(f"e_{k}" for k in (*MEANS, "macd_signal", "adx")), *(f"n_{k}" for k in (*MEANS, "macd_signal", "adx")), "since_dx", "way", "up_band", "low_band", *RINGS)
COLUMNS = ("ticker", *_HELD, *(c for c in SHOWN))


# One day -------------------------------------------------------------------------------------------------------------


def _ring(name: str, x: str, n: int) -> str:
    return f"slice(concat(array(cast({x} AS double)), coalesce(s.{name}, cast(array() AS array<double>))), 1, {n})"


def _known(ring: str, n: int) -> str:
    return f"array_compact(slice({ring}, 1, {n}))"


def _of(agg: str, ring: str, n: int, least: int) -> str:
    """An aggregate of a ring's first n values, if ``least`` of them are known."""
    own = _known(ring, n)
    total = f"aggregate({own}, 0e0, (t, x) -> t + x)"
    return f"CASE WHEN size({own}) >= {least} THEN " + {"max": f"array_max({own})", "min": f"array_min({own})", "sum": total, "avg": f"{total} / size({own})"}[agg] + " END"


def _spread(x: str, mean: str, by: str) -> str:
    """Standard deviation of an array around its mean; ``by`` divides the squares."""
    return f"sqrt(aggregate({x}, 0e0, (t, x) -> t + (x - {mean}) * (x - {mean})) / ({by}))"


def _since(ring: str, extreme: str) -> str:
    """100 times the share of 25 bars since the extreme of them, the oldest of equal ones."""
    own = f"slice({ring}, 1, 25)"
    return f"CASE WHEN size({_known(ring, 25)}) = 25 THEN 100 * array_position(reverse({own}), {extreme}({own})) / 25e0 END"


def _mean_step(k: str, x: str, first: str, alpha: float) -> dict[str, str]:
    return {f"e_{k}": f"{d(1 - alpha)} * coalesce(s.e_{k}, 0e0) + CASE WHEN {first} THEN 1e0 ELSE {d(alpha)} END * coalesce({x}, 0e0)", f"n_{k}": f"coalesce(s.n_{k}, 0L) + CASE WHEN {x} IS NULL THEN 0L ELSE 1L END"}


def _dx_steps() -> dict[str, str]:
    alpha = 1 / 14
    kept = f"exp(s.since_dx * {d(math.log(1 - alpha))})"
    return {
        "e_adx": f"CASE WHEN dx IS NULL THEN coalesce(s.e_adx, 0e0) WHEN s.since_dx IS NULL THEN dx ELSE ({kept} * s.e_adx + {d(alpha)} * dx) / ({kept} + {d(alpha)}) END",
        "n_adx": "coalesce(s.n_adx, 0L) + CASE WHEN dx IS NULL THEN 0L ELSE 1L END",
        "since_dx": "CASE WHEN dx IS NOT NULL THEN 1L ELSE s.since_dx + 1L END",
    }


#: Columns of a day, layer by layer, over a state ``s`` (null for a new ticker) and a bar ``b``.
DAY = (
    {"date": "b.date", "close": "b.close", "high": "b.high", "low": "b.low", "volume": "b.volume", "rn": "coalesce(s.rn + 1, 0L)", "pc": "s.close", "ph": "s.high", "pl": "s.low", "ptp": "s.tp", "tp": "(b.high + b.low + b.close) / 3e0"},
    {"tr": "greatest(high - low, abs(high - pc), abs(low - pc))", "up": "CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0e0) END", "down": "CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0e0) END",
     "plus_dm": "CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0e0 END", "minus_dm": "CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0e0 END",
     "bp": "close - least(low, pc)", "flow_up": "CASE WHEN tp > ptp THEN tp * volume ELSE 0e0 END", "flow_down": "CASE WHEN tp < ptp THEN tp * volume ELSE 0e0 END",
     "obv": "coalesce(s.obv, 0e0) + coalesce(sign(close - pc) * volume, 0e0)", **{r: _ring(r, x, n) for r, (x, n) in RINGS.items() if r in ("r_close", "r_high", "r_low", "r_tp")}},
    {**{r: _ring(r, x, n) for r, (x, n) in RINGS.items() if r in ("r_tr", "r_bp", "r_up", "r_down")}, **{c: x for k, (series, first, alpha, _) in MEANS.items() for c, x in _mean_step(k, series, first, alpha).items()},
     **{f"sma{n}": f"CASE WHEN rn + 1 >= {max(2, n // 2)} THEN {_of('avg', 'r_close', n, 1)} END" for n in MA}, "tp_mean": _of("avg", "r_tp", 20, 10), "near": _known("r_close", 20),
     **{f"hh{n}": _of("max", "r_high", n, n // 2) for n in (9, 14, 20, 26)}, **{f"ll{n}": _of("min", "r_low", n, n // 2) for n in (9, 14, 20, 26)}, "hh52": _of("max", "r_high", 52, 26), "ll52": _of("min", "r_low", 52, 26),
     "aroon_up": _since("r_high", "array_max"), "aroon_down": _since("r_low", "array_min"), "roc12": "100 * (close / nullif(get(r_close, 12), 0) - 1)",
     "year": "slice(r_close, 1, 252)", "rets": "array_compact(transform(slice(r_close, 1, 252), (x, i) -> x / nullif(get(r_close, i + 1), 0) - 1))"},
    {**{k: f"CASE WHEN n_{k} >= {least} THEN e_{k} END" for k, (_, _, _, least) in MEANS.items()}, "near_mean": "aggregate(near, 0e0, (t, x) -> t + x) / size(near)",
     **{f"uo{n}": f"({_of('sum', 'r_bp', n, n // 2)}) / nullif({_of('sum', 'r_tr', n, n // 2)}, 0)" for n in (7, 14, 28)}, "mfi_up": _of("sum", "r_up", 14, 7), "mfi_down": _of("sum", "r_down", 14, 7),
     "raw_k14": "100 * (close - ll14) / nullif(hh14 - ll14, 0)", "williams": "-100 * (hh14 - close) / nullif(hh14 - ll14, 0)", "tp_dev": "abs(tp - tp_mean)", "donchian": "(close - ll20) / nullif(hh20 - ll20, 0)",
     "mid9": "(hh9 + ll9) / 2", "mid26": "(hh26 + ll26) / 2", "mid52": "(hh52 + ll52) / 2", "ret_mean": "aggregate(rets, 0e0, (t, x) -> t + x) / nullif(size(rets), 0)",
     "max_drawdown252": "CASE WHEN size(year) >= 20 THEN aggregate(reverse(year), struct(cast(NULL AS double) AS top, cast(NULL AS double) AS worst), (t, x) -> struct(greatest(t.top, x) AS top, least(t.worst, x / nullif(greatest(t.top, x), 0) - 1) AS worst)).worst END"},
    {"sd20": f"CASE WHEN size(near) >= 10 THEN {_spread('near', 'near_mean', 'size(near)')} END", "vol252": f"CASE WHEN size(rets) > 20 THEN {_spread('rets', 'ret_mean', 'size(rets) - 1')} * sqrt(252e0) END",
     "macd_line": "ema12 - ema26", "rsi14": "CASE WHEN avg_down IS NOT NULL THEN coalesce(100 - 100 / (1 + avg_up / nullif(avg_down, 0)), 50e0) END",
     "plus_di": "100 * plus_s / nullif(atr14, 0)", "minus_di": "100 * minus_s / nullif(atr14, 0)", "ultimate": "100 * (4 * uo7 + 2 * uo14 + uo28) / 7", "mfi": "100 - 100 / (1 + mfi_up / nullif(mfi_down, 0))",
     **{r: _ring(r, x, n) for r, (x, n) in RINGS.items() if r in ("r_raw", "r_dev", "r_mid", "r_mid52")}, "u": "(high + low) / 2 + 3 * atr10", "l": "(high + low) / 2 - 3 * atr10"},
    {"dx": "100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0)", "stoch_k": _of("avg", "r_raw", 3, 1), "tp_md": _of("avg", "r_dev", 20, 10), "r_rsi": _ring("r_rsi", *RINGS["r_rsi"]),
     "bb_upper": "sma20 + 2 * sd20", "bb_lower": "sma20 - 2 * sd20", "span_a": "get(r_mid, 26)", "span_b": "get(r_mid52, 26)", **_mean_step("macd_signal", "macd_line", "coalesce(s.n_macd_signal, 0L) = 0", 0.2),
     "way": "CASE WHEN u IS NULL THEN s.way WHEN close > coalesce(s.up_band, u) THEN 1e0 WHEN close < coalesce(s.low_band, l) THEN -1e0 ELSE coalesce(s.way, 1e0) END",
     "up_band": "CASE WHEN u IS NULL THEN s.up_band WHEN s.up_band IS NULL OR s.way < 0 THEN u ELSE least(u, s.up_band) END", "low_band": "CASE WHEN u IS NULL THEN s.low_band WHEN s.low_band IS NULL OR s.way > 0 THEN l ELSE greatest(l, s.low_band) END"},
    {"r_k": _ring("r_k", *RINGS["r_k"]), **_dx_steps(), "pct_b": "(close - bb_lower) / nullif(bb_upper - bb_lower, 0)", "bb_width": "nullif(bb_upper - bb_lower, 0) / nullif(sma20, 0)",
     "cci": "(tp - tp_mean) / (0.015e0 * nullif(tp_md, 0))", "macd_signal": "CASE WHEN n_macd_signal >= 9 THEN e_macd_signal END", "rsi_low": _of("min", "r_rsi", 14, 7), "rsi_high": _of("max", "r_rsi", 14, 7),
     "ichimoku": "CASE WHEN coalesce(span_a, span_b) IS NULL THEN NULL WHEN close > greatest(span_a, span_b) THEN 1e0 WHEN close < least(span_a, span_b) THEN -1e0 ELSE 0e0 END", "supertrend": "CASE WHEN atr10 IS NOT NULL THEN way END"},
    {"stoch_d": _of("avg", "r_k", 3, 1), "adx": "CASE WHEN n_adx >= 14 THEN e_adx END", "macd_hist": "macd_line - macd_signal",
     "stoch_rsi": "CASE WHEN rsi14 IS NOT NULL AND rsi_high > rsi_low THEN greatest(0e0, least(100e0, 100 * (rsi14 - rsi_low) / (rsi_high - rsi_low))) END"},
)


def advance(state: DataFrame, bars: DataFrame) -> DataFrame:
    """The state after one day, from the state before it and the day's bars (of one date). One outer join by ticker: the state isn't shuffled where it is stored in buckets."""
    own = bars.where("close IS NOT NULL AND ticker IS NOT NULL").selectExpr("ticker", "struct(date, close, high, low, volume) AS b").groupBy("ticker").agg(F.max("b").alias("b"))
    both = state.selectExpr("ticker", f"struct({', '.join(COLUMNS[1:])}) AS s").join(own, "ticker", "full")
    rows = both
    for step in DAY:
        rows = rows.selectExpr("*", *(f"{x} AS {c}" for c, x in step.items()))
    types = dict(state.dtypes)
    new = ", ".join(f"cast({c} AS {types[c]}) AS {c}" for c in COLUMNS[1:])
    return rows.selectExpr("ticker", f"CASE WHEN b IS NULL OR b.date <= s.date THEN s ELSE struct({new}) END AS s").select("ticker", "s.*")


# Whole histories -----------------------------------------------------------------------------------------------------


def _begin() -> Rel:
    rows = layers(
        "state_rows",
        AROON,
        # A mean that isn't shown yet lies in its first block, but for ranges, which may be missing for long.
        {**{f"e_{k}": ewm_whole(x, f"in_{k}", a, 0) if x == "tr" else f"coalesce({k}, in_{k}, 0e0)" for k, (x, _, a, _) in MEANS.items()}, "e_macd_signal": "coalesce(macd_signal, in_macd_signal, 0e0)",
         "e_adx": f"CASE WHEN count(dx) {over()} > 0 THEN coalesce(in_adx, 0e0) + exp(dx_kept) * {carried('in_adx', 1 / 14)} ELSE 0e0 END",
         **{f"n_{k}": f"count(tr) {over()}" if x == "tr" else "rn" if x in ("up", "down") else "rn + 1" for k, (x, _, _, _) in MEANS.items()}, "n_macd_signal": f"count(macd_line) {over()}", "n_adx": f"count(dx) {over()}",
         "since_dx": f"CASE WHEN dx IS NOT NULL THEN 1 ELSE {gap_since('dx')} + 1 END"},
    )
    last = [c for c in COLUMNS[1:] if c not in (*RINGS, "way", "up_band", "low_band", "supertrend", "max_drawdown252", "vol252", "date")]
    # Lists are gathered from narrow rows: what only the last bar gives lies in one field, which other bars lack, and bars that no ring reaches stay out.
    reach = max(n for _, n in RINGS.values())
    narrow = Rel(
        "state_tail",
        f"SELECT ticker, date, rd, CASE WHEN rd = 1 THEN struct({', '.join(last)}) END AS last, {', '.join(f'cast({x} AS double) AS {r}' for r, (x, _) in RINGS.items())}, close, ret, drawdown FROM state_rows WHERE rd <= {reach}",
        (rows,),
    )
    held = [
        "max(date) AS date",
        "first(last, TRUE) AS last",
        *(f"transform(array_sort(collect_list(struct(rd AS o, {r} AS v)) FILTER (WHERE rd <= {n})), x -> x.v) AS {r}" for r, (_, n) in RINGS.items()),
        "CASE WHEN count(CASE WHEN rd <= 252 THEN close END) >= 20 THEN min(drawdown) END AS max_drawdown252",
        "CASE WHEN count(CASE WHEN rd <= 252 THEN ret END) > 20 THEN stddev_samp(CASE WHEN rd <= 252 THEN ret END) * sqrt(252e0) END AS vol252",
    ]
    return Rel("begun", f"SELECT *, {', '.join(f'last.{c} AS {c}' for c in last)} FROM (SELECT ticker, {', '.join(held)} FROM state_tail GROUP BY ticker) x", (narrow,))


BEGUN = _begin()
_RANGE = {"atr10": indicators._WILDER["atr10"]}
#: What Supertrend's bands need of the indicators.
RANGES = layers("ranges", BASE, indicators._inner(_RANGE), indicators._whole(_RANGE))


def begin(spark: SparkSession, bars: DataFrame) -> DataFrame:
    """The state after all of ``bars``, in one pass over the histories."""
    bars = bars.where("ticker IS NOT NULL")
    bands = directions(BANDS.on(spark, indicators=RANGES.on(spark, bars=bars)), bounds=True, dealt=True).groupBy("ticker").agg(F.max_by(F.struct("dir", "up", "low"), "date").alias("t"), F.max("date").alias("at"))
    rows = BEGUN.on(spark, bars=bars).join(bands, "ticker", "left")
    rows = rows.selectExpr("*", "t.dir AS way", "t.up AS up_band", "t.low AS low_band", "CASE WHEN atr10 IS NOT NULL THEN t.dir END AS supertrend")
    whole = {"rn": "bigint", "since_dx": "bigint", **{f"n_{k}": "bigint" for k in (*MEANS, "macd_signal", "adx")}}
    kinds = {c: whole.get(c, "double") for c in COLUMNS[1:] if c not in RINGS} | {"date": dict(bars.dtypes)["date"]}
    return rows.selectExpr("ticker", *(c if c in RINGS else f"cast({c} AS {kinds[c]}) AS {c}" for c in COLUMNS[1:]))


# Versions ------------------------------------------------------------------------------------------------------------


class DailyState:
    """A stored state per day. ``run`` brings it up to the last day of the bars; what a dead run has left isn't read."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets, self.versions = spark, path.rstrip("/"), buckets, SnapshotStore(spark, path)

    def days(self) -> list[str]:
        return self.versions.days()

    def at(self, day: str | None = None) -> DataFrame:
        """The state after a day, the last one without it."""
        found = self.versions.manifest(self.versions.version())
        return layout.load(self.spark, f"{self.path}/{found[day or max(found)]}")

    def _put(self, state: DataFrame, day: str, read_at: int) -> None:
        folder = f"data/{uuid.uuid4().hex}/state"
        layout.save(state, f"{self.path}/{folder}", order=(), buckets=self.buckets)
        self.versions.publish({day: folder}, read_at)

    def run(self, bars: DataFrame) -> list[str]:
        """Days that were added: the first run takes all histories at once, later ones the days since, one after the other (bars that are stored by date are pruned to them).

        Two runs at once can't both add a day: the later one gets a Conflict.
        """
        read_at = self.versions.version()
        known = self.versions.days(read_at)
        bars = bars.where("close IS NOT NULL AND ticker IS NOT NULL")
        if not known:
            if (day := bars.agg(F.max("date").cast("string")).first()[0]) is None:
                return []
            self._put(begin(self.spark, bars), day, read_at)
            return [day]
        new = bars.where(F.col("date") > F.lit(max(known)).cast(dict(bars.dtypes)["date"]))
        days = sorted(r[0] for r in new.select(F.col("date").cast("string")).distinct().collect())  # a row a day
        for day in days:
            if self.versions.days() != known:
                raise Conflict(f"another run has added days after {known[-1]}")
            state = self.at(known[-1])
            self._put(advance(state, new.where(F.col("date").cast("string") == day)), day, self.versions.version())
            known = [*known, day]
        return days

    def indicators(self, day: str | None = None) -> DataFrame:
        """The indicators of the tickers that have a bar on a day (the last one without it)."""
        day = day or max(self.days())
        return self.at(day).where(F.col("date").cast("string") == day).select("ticker", "date", *SHOWN)


# Queries -------------------------------------------------------------------------------------------------------------

#: Days that the query carries its state over.
CARRIED = 3
_ROUNDED = ", ".join(f"round({c}, 5) AS {c}" for c in SHOWN)


@REG.function
def in_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of the last days of the bars, carried from the state of the day before them: equal to those of whole histories."""
    bars = kept(BARS, spark, sf_dir)
    days = [r[0] for r in bars.where("close IS NOT NULL").select("date").distinct().orderBy(F.desc("date")).limit(CARRIED).collect()][::-1]
    state = written(begin(spark, bars.where(F.col("date") < days[0])), "state")
    out = []
    for day in days:
        state = written(advance(state, bars.where(F.col("date") == day)), "state")
        out.append(state.where(F.col("date") == day))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.selectExpr("ticker", "date", *(f"round({c}, 5) AS {c}" for c in SHOWN))


def _whole_text() -> str:
    special = {
        "rsi14": "CASE WHEN avg_down IS NOT NULL THEN rsi14 END", "stoch_rsi": "CASE WHEN avg_down IS NOT NULL THEN stoch_rsi END", "supertrend": "dir",
        "max_drawdown252": f"CASE WHEN count(*) {over(252)} >= 20 THEN worst END", "vol252": f"CASE WHEN count(ret) {over(252)} > 20 THEN stddev_samp(ret) {over(252)} * sqrt(252e0) END",
    }
    columns = ", ".join(f"{special.get(c, c)} AS {c}" for c in SHOWN)
    # The worst fall within a year of closes up to each of the last days: each pair of a bar and an earlier high of the same year.
    return f"""SELECT ticker, date, {columns} FROM aroon LEFT JOIN (SELECT ticker AS turned, date AS day, dir FROM supertrend_series) t ON turned = ticker AND day = date
        LEFT JOIN (SELECT e.ticker AS fallen, e.i AS place, min(y.close / nullif(h.close, 0) - 1) AS worst FROM (SELECT ticker, i FROM aroon WHERE date IN (SELECT date FROM last_days)) e
                   JOIN aroon y ON y.ticker = e.ticker AND y.i BETWEEN e.i - 251 AND e.i JOIN aroon h ON h.ticker = e.ticker AND h.i BETWEEN e.i - 251 AND y.i GROUP BY e.ticker, e.i) w ON fallen = ticker AND place = i"""


_DAYS = Rel("last_days", f"SELECT DISTINCT date FROM bars WHERE close IS NOT NULL ORDER BY date DESC LIMIT {CARRIED}", (BARS,))
#: The same rows from whole histories: the statement for the second engine.
ORACLE = Rel("daily_oracle", f"SELECT ticker, date, {_ROUNDED} FROM whole_days WHERE date IN (SELECT date FROM last_days)", (Rel("whole_days", _whole_text(), (AROON, SUPERTREND_SERIES, _DAYS)), _DAYS))
