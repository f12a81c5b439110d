"""Thirty technical votes of -1, 0 or 1 from each ticker's last values, and their summary."""

from __future__ import annotations

from rankloom.operators.profile import CUTS, LAST, SUPERTREND, TAIL
from rankloom.plans.rel import Rel, Registry

REG = Registry(CUTS)


def _sign(up: str, down: str) -> str:
    return f"CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END"


def _strict(up: str, known: str) -> str:
    """Anything but up is down, if the values are known."""
    return f"CASE WHEN {known} THEN CASE WHEN {up} THEN 1 ELSE -1 END ELSE 0 END"


VOTES = {f"{k}{n}": f"CASE WHEN n >= {n // 2} THEN CASE WHEN close > {k}{n} THEN 1 ELSE -1 END END" for n in (5, 10, 20, 50, 100, 200) for k in ("sma", "ema")} | {
    "rsi": _sign("rsi14 < 30", "rsi14 > 70"),
    "stoch": _sign("raw_k9 < 20", "raw_k9 > 80"),
    "stochrsi": _sign("stoch_rsi < 20", "stoch_rsi > 80"),
    "macd": _strict("macd_line > macd_signal", "macd_line IS NOT NULL AND macd_signal IS NOT NULL"),
    "adx": _strict("plus_di > minus_di", "adx > 20 AND plus_di IS NOT NULL AND minus_di IS NOT NULL"),
    "williams": _sign("williams < -80", "williams > -20"),
    "cci": _sign("cci > 100", "cci < -100"),
    "roc": _strict("roc12 > 0", "roc12 IS NOT NULL"),
    "ultimate": _sign("ultimate < 30", "ultimate > 70"),
    "bollinger": "CASE WHEN pct_b > 1.05 THEN -1 WHEN pct_b > 0.5 THEN 1 WHEN pct_b < 0 THEN -1 ELSE 0 END",
    "aroon": _sign("aroon_up > 70 AND aroon_up > aroon_down", "aroon_down > 70 AND aroon_down > aroon_up"),
    "mfi": _sign("mfi < 20", "mfi > 80"),
    "donchian": _sign("donchian > 0.80", "donchian < 0.20"),
    "supertrend": _sign("supertrend > 0", "supertrend < 0"),
    "ichimoku": _sign("ichimoku > 0", "ichimoku < 0"),
    "ma_cross": _strict("sma50 > sma200", "sma50 IS NOT NULL AND sma200 IS NOT NULL"),
    "trend_quality": _sign("trend_r2 > 0.55", "trend_r2 < -0.35"),
    "volume_confirm": "CASE WHEN n > 60 THEN CASE WHEN vol20 / nullif(vol60, 0) > 1.15 THEN CASE WHEN close > sma20 THEN 1 ELSE -1 END ELSE 0 END END",
}

VOTED = Rel(
    "votes",
    "SELECT l.ticker, last_date, n, "
    + ", ".join(f"{v} AS vote_{k}" for k, v in VOTES.items())
    + " FROM last_values l LEFT JOIN supertrend s ON s.ticker = l.ticker LEFT JOIN tail_stats t ON t.ticker = l.ticker WHERE n >= 30",
    (LAST, SUPERTREND, TAIL),
)


def _count(test: str, names: list[str]) -> str:
    return " + ".join(f"CASE WHEN vote_{k} {test} THEN 1 ELSE 0 END" for k in names)


_ALL = list(VOTES)
_MA = [k for k in VOTES if k[:3] in ("sma", "ema")]
_OSC = [k for k in VOTES if k not in _MA]

SUMMARY = Rel(
    "summary",
    f"""
    SELECT *, (buys - sells) / greatest(1e0, buys + sells + neutrals) AS ratio, greatest(0e0, least(100e0, 50 + 50 * (buys - sells) / greatest(1e0, buys + sells + neutrals))) AS technical_score,
           CASE WHEN (buys - sells) / greatest(1e0, buys + sells + neutrals) >= 0.50 THEN 'STRONG_BUY' WHEN (buys - sells) / greatest(1e0, buys + sells + neutrals) >= 0.15 THEN 'BUY'
                WHEN (buys - sells) / greatest(1e0, buys + sells + neutrals) >= -0.15 THEN 'NEUTRAL' WHEN (buys - sells) / greatest(1e0, buys + sells + neutrals) >= -0.50 THEN 'SELL' ELSE 'STRONG_SELL' END AS label
    FROM (SELECT ticker, {_count("> 0", _ALL)} AS buys, {_count("< 0", _ALL)} AS sells, {_count("= 0", _ALL)} AS neutrals, {_count("> 0", _MA)} AS ma_buys, {_count("< 0", _MA)} AS ma_sells,
                 {_count("> 0", _OSC)} AS osc_buys, {_count("< 0", _OSC)} AS osc_sells FROM votes) x""",
    (VOTED,),
)
REG.rel("sig_votes", "SELECT * FROM votes", VOTED)
REG.rel("sig_summary", "SELECT ticker, buys, sells, neutrals, ma_buys, ma_sells, osc_buys, osc_sells, round(ratio, 6) AS ratio, round(technical_score, 6) AS technical_score, label FROM summary", SUMMARY)

