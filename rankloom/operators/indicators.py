"""Technical indicators of every bar, as layers of window expressions over ``bars``.

All windows share one partitioning by ticker, so the whole frame costs one shuffle. Where the reference
semantics are unusual they are kept: RSI is 50 without losses, MACD and ADX follow pandas' ``ewm``.
"""

from __future__ import annotations

from collections.abc import Callable

from rankloom.functions.expr import BLOCK, carried, ewm_inner, ewm_whole, gap_since, gap_steps, lag, mean, over, r6, roll, span, whole
from rankloom.plans.rel import Rel, Registry
from rankloom.sources.adapters import BARS

#: Bars are dealt by ticker and summed up once; each query's windows are over them.
REG = Registry((BARS,))


def one_order(q, text: str) -> str:
    """Windows over numbered bars, on Spark all in the order (ticker, blk, date), which is that of time: narrow bars are sorted by it once, and no window sorts the rows, which get wide, anew."""
    return text.replace("PARTITION BY ticker ORDER BY date", "PARTITION BY ticker ORDER BY blk, date") if q.name == "spark" else text


def layers(name: str, source: Rel, *steps: dict[str, str | Callable], plain: int = 0) -> Rel:
    """Relations that add columns step by step; a step may use the columns of those before it. The first ``plain`` steps come before the bars' blocks are known. A callable gives a dialect's spelling."""
    for i, step in enumerate(steps):
        last = i == len(steps) - 1

        def body(q, step=step, read=source.name, known=i >= plain) -> str:
            columns = ", ".join(f"{x(q) if callable(x) else one_order(q, x) if known else x} AS {c}" for c, x in step.items())
            return f"SELECT *, {columns} FROM {read}"

        source = Rel(name if last else f"{name}_{i}", body, (source,))
    return source


def backwards(q) -> str:
    """Number of a bar from its ticker's last one on. Spark counts instead of sorting the other way round."""
    return f"count(*) {whole()} - rn" if q.name == "spark" else "row_number() OVER (PARTITION BY ticker ORDER BY date DESC)"


#: Bars with a close, numbered.
CLOSED = Rel("closed_bars", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS rn FROM bars WHERE close IS NOT NULL", (BARS,))
BASE = layers(
    "indicator_base",
    CLOSED,
    {"i": "rn", "total": f"sum(close) {over()}", "blk": f"cast(floor(rn / {BLOCK}e0) AS bigint)", "pos": f"rn % {BLOCK}", "pc": lag("close"), "ph": lag("high"), "pl": lag("low"), "tp": "(high + low + close) / 3e0",
     "rd": backwards, "n_bars": f"count(*) {whole()}"},
    {"tr": "greatest(high - low, abs(high - pc), abs(low - pc))", "up": "CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0e0) END", "down": "CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0e0) END",
     "plus_dm": "CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0e0 END", "minus_dm": "CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0e0 END",
     "bp": "close - least(low, pc)", "ret": "close / nullif(pc, 0) - 1", "ptp": lag("tp")},
    plain=1,
)

#: The moving averages that the signals and factors use.
MA = (5, 10, 20, 50, 100, 150, 200)
EMA = (5, 10, 12, 20, 26, 50, 100, 200)

#: Name -> (series, its first value, alpha, least values) of the weighted means over bars.
_MEANS = {f"ema{n}": ("close", "i = 0", span(n), max(2, n // 2)) for n in EMA}
_WILDER = {"avg_up": ("up", "i = 1", 1 / 14, 14), "avg_down": ("down", "i = 1", 1 / 14, 14), "atr14": ("tr", "i = 0", 1 / 14, 14), "atr10": ("tr", "i = 0", 1 / 10, 10),
           "plus_s": ("plus_dm", "i = 0", 1 / 14, 14), "minus_s": ("minus_dm", "i = 0", 1 / 14, 14)}


def _inner(means: dict) -> dict[str, str]:
    return {f"in_{k}": ewm_inner(x, first, alpha) for k, (x, first, alpha, _) in means.items()}


def _whole(means: dict) -> dict[str, str]:
    return {k: ewm_whole(x, f"in_{k}", alpha, least) for k, (x, _, alpha, least) in means.items()}


AVERAGES = layers("averages", BASE, _inner(_MEANS), {f"sma{n}": mean("total", n) for n in MA} | _whole(_MEANS))
_KEPT, _WEIGHT = gap_steps("dx", "dx_gap", 1 / 14)
_SIGNAL = {"macd_signal": ("macd_line", "i_macd = 0", span(9), 9)}

INDICATORS = layers(
    "indicators",
    BASE,
    _inner(_MEANS | _WILDER),
    {**{f"sma{n}": mean("total", n) for n in MA}, **_whole(_MEANS | _WILDER),
     "tp_mean": roll("avg", "tp", 20, 10), "sd20": roll("stddev_pop", "close", 20, 10), "obv": f"sum(coalesce(sign(close - pc) * volume, 0e0)) {over()}",
     **{f"hh{n}": roll("max", "high", n, n // 2) for n in (9, 14, 20, 26)}, **{f"ll{n}": roll("min", "low", n, n // 2) for n in (9, 14, 20, 26)}, "top26": f"max(high) {over(26)}", "bottom26": f"min(low) {over(26)}", "seen_high": f"count(high) {over(52)}", "seen_low": f"count(low) {over(52)}",
     "flow_up": "CASE WHEN tp > ptp THEN tp * volume ELSE 0e0 END", "flow_down": "CASE WHEN tp < ptp THEN tp * volume ELSE 0e0 END",
     "drawdown": f"CASE WHEN rd <= 252 THEN close / nullif(max(CASE WHEN rd <= 252 THEN close END) {over()}, 0) - 1 END",
     **{f"uo{n}": f"({roll('sum', 'bp', n, n // 2)}) / nullif({roll('sum', 'tr', n, n // 2)}, 0)" for n in (7, 14, 28)}},
    {"macd_line": "ema12 - ema26", "rsi14": f"CASE WHEN max(avg_down) {whole()} IS NOT NULL THEN coalesce(100 - 100 / (1 + avg_up / nullif(avg_down, 0)), 50e0) END",
     "plus_di": "100 * plus_s / nullif(atr14, 0)", "minus_di": "100 * minus_s / nullif(atr14, 0)",
     "raw_k14": "100 * (close - ll14) / nullif(hh14 - ll14, 0)", "raw_k9": "100 * (close - ll9) / nullif(hh9 - ll9, 0)", "williams": "-100 * (hh14 - close) / nullif(hh14 - ll14, 0)",
     "tp_dev": "abs(tp - tp_mean)", "roc12": f"100 * (close / nullif({lag('close', 12)}, 0) - 1)", "ultimate": "100 * (4 * uo7 + 2 * uo14 + uo28) / 7",
     "bb_upper": "sma20 + 2 * sd20", "bb_lower": "sma20 - 2 * sd20", "donchian": "(close - ll20) / nullif(hh20 - ll20, 0)",
     "mfi_up": roll("sum", "flow_up", 14, 7), "mfi_down": roll("sum", "flow_down", 14, 7),
     "mid9": "(hh9 + ll9) / 2", "mid26": "(hh26 + ll26) / 2", "mid52": f"CASE WHEN seen_high >= 26 AND seen_low >= 26 THEN (greatest(top26, {lag('top26', 26)}) + least(bottom26, {lag('bottom26', 26)})) / 2 END"},
    {"i_macd": f"CASE WHEN macd_line IS NOT NULL THEN count(macd_line) {over()} - 1 END", "dx": "100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0)", "stoch_k": roll("avg", "raw_k14", 3, 1),
     "rsi_low": roll("min", "rsi14", 14, 7), "rsi_high": roll("max", "rsi14", 14, 7), "tp_md": roll("avg", "tp_dev", 20, 10),
     "pct_b": "(close - bb_lower) / nullif(bb_upper - bb_lower, 0)", "bb_width": "nullif(bb_upper - bb_lower, 0) / nullif(sma20, 0)",
     "mfi": "100 - 100 / (1 + mfi_up / nullif(mfi_down, 0))", "span_a": lag("(mid9 + mid26) / 2", 26), "span_b": lag("mid52", 26)},
    {"stoch_d": roll("avg", "stoch_k", 3, 1), "dx_gap": gap_since("dx"),
     "stoch_rsi": "CASE WHEN rsi_high > rsi_low THEN greatest(0e0, least(100e0, 100 * (rsi14 - rsi_low) / (rsi_high - rsi_low))) END", "cci": "(tp - tp_mean) / (0.015e0 * nullif(tp_md, 0))",
     "ichimoku": "CASE WHEN coalesce(span_a, span_b) IS NULL THEN NULL WHEN close > greatest(span_a, span_b) THEN 1e0 WHEN close < least(span_a, span_b) THEN -1e0 ELSE 0e0 END"},
    {"dx_kept": f"sum({_KEPT}) OVER (PARTITION BY ticker, blk ORDER BY date)", "dx_weight": _WEIGHT, **_inner(_SIGNAL)},
    {"in_adx": "exp(dx_kept) * sum(dx_weight * dx * exp(-dx_kept)) OVER (PARTITION BY ticker, blk ORDER BY date)"},
    {**_whole(_SIGNAL), "adx": f"CASE WHEN count(dx) {over()} >= 14 THEN coalesce(in_adx, 0e0) + exp(dx_kept) * {carried('in_adx', 1 / 14)} END"},
    {"macd_hist": "macd_line - macd_signal"},
)


def show(name: str, source: Rel, *columns: str, where: str = "") -> Rel:
    """A registered query: rounded columns by ticker and date."""
    picked = ", ".join(f"{r6(c)} AS {c}" for c in columns)
    return REG.rel(name, f"SELECT ticker, date, {picked} FROM {source.name}{where}", source)


REG.rel("src_bars", f"SELECT ticker, date, {', '.join(f'{r6(c)} AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars", BARS)
show("in_sma", AVERAGES, *(f"sma{n}" for n in MA))
show("in_ema", AVERAGES, *(f"ema{n}" for n in EMA))
show("in_rsi14", INDICATORS, "rsi14")
show("in_stoch", INDICATORS, "stoch_k", "stoch_d")
show("in_stoch_rsi", INDICATORS, "stoch_rsi")
show("in_macd", INDICATORS, "macd_line", "macd_signal", "macd_hist")
show("in_true_range", BASE, "tr")
show("in_atr", INDICATORS, "atr14", "atr10")
show("in_adx", INDICATORS, "adx", "plus_di", "minus_di")
show("in_williams_r", INDICATORS, "williams")
show("in_cci", INDICATORS, "cci")
show("in_roc", INDICATORS, "roc12")
show("in_ultimate", INDICATORS, "ultimate")
show("in_obv", INDICATORS, "obv")
show("in_bollinger", INDICATORS, "bb_upper", "bb_lower", "pct_b", "bb_width")
show("in_mfi", INDICATORS, "mfi")
show("in_donchian", INDICATORS, "donchian")
show("in_ichimoku", INDICATORS, "ichimoku")

#: Bars since the highest high and lowest low of the last 25; of equal ones the oldest.
AROON = Rel(
    "aroon",
    lambda q: one_order(q, f"""
    SELECT *, 100 * (25 - (i - hi_at)) / 25e0 AS aroon_up, 100 * (25 - (i - lo_at)) / 25e0 AS aroon_down
    FROM (SELECT *,
                 CASE WHEN count(high) {over(25)} = 25 THEN min_by(i, CASE WHEN high IS NOT NULL THEN {q.row("-high", "i")} END) {over(25)} END AS hi_at,
                 CASE WHEN count(low) {over(25)} = 25 THEN min_by(i, CASE WHEN low IS NOT NULL THEN {q.row("low", "i")} END) {over(25)} END AS lo_at
          FROM indicators) x"""),
    (INDICATORS,),
)
show("in_aroon", AROON, "aroon_up", "aroon_down")
