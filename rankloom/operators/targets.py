"""Price targets, stops, sell rules and risk level of each security or position."""

from __future__ import annotations

from rankloom.operators.profile import FEATURES
from rankloom.operators.indicators import BASE
from rankloom.operators.scoring import CUTS, RUN
from rankloom.plans.numbering import numbering
from rankloom.plans.rel import Rel, Registry
from rankloom.sources.adapters import FUNDAMENTALS, POSITIONS

REG = Registry()


def swings(name: str, window: int, lookback: int) -> Rel:
    """Bars of the last ``lookback`` that are the highest or lowest of ``window`` bars on either side."""
    around = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {window} PRECEDING AND {window} FOLLOWING)"
    return Rel(
        name,
        f"""SELECT ticker, date, high, low, high = max(high) {around} AS is_high, low = min(low) {around} AS is_low,
                   rd >= {window + 1} AND rd <= least(n_bars, {lookback}) - {window} AND least(n_bars, {lookback}) >= {3 * window} AS inner_bar FROM indicator_base""",
        (BASE,),
    )


SWINGS = swings("swings", 10, 252)
SHORT_SWINGS = swings("short_swings", 8, 126)
#: Resistance levels: swing highs, merged in ascending order where they lie within two percent.
LEVELS = Rel("levels", lambda q: f"SELECT ticker, {q.explode('merged')} AS level FROM (SELECT ticker, {q.merge_levels('high', 0.02)} AS merged FROM swings WHERE is_high AND inner_bar GROUP BY ticker) x", (SWINGS,))

_RES = Rel(
    "resistances",
    """
    SELECT f.ticker, min(r.level) AS next_resistance, min(CASE WHEN r.level >= f.price + greatest(f.price * 0.04e0, coalesce(f.atr14, 0e0)) THEN r.level END) AS clear_resistance
    FROM features f JOIN (SELECT ticker, round(level, 4) AS level FROM levels UNION ALL SELECT ticker, round(hi252, 4) FROM features) r ON r.ticker = f.ticker
    WHERE r.level > f.price * 1.01e0 GROUP BY f.ticker""",
    (FEATURES, LEVELS),
)
_A, _B, _C = "next_resistance", "CASE WHEN atr14 > 0 THEN price + 3 * atr14 END", "CASE WHEN n > 60 AND hi126 > lo126 THEN price + 0.6e0 * (hi126 - lo126) END"
SHORT = Rel(
    "short_targets",
    f"""
    SELECT ticker, price, atr14, next_resistance, CASE WHEN atr14 > 0 AND snapped < price + 1.5e0 * atr14 THEN price + 1.5e0 * atr14 ELSE snapped END AS short_target
    FROM (SELECT *, CASE WHEN abs(clear_resistance - middle) / middle < 0.15 THEN clear_resistance ELSE middle END AS snapped
          FROM (SELECT *, CASE WHEN (a IS NULL) OR (b IS NULL) OR (c IS NULL) THEN CASE WHEN (CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END) = 2
                                  THEN (coalesce(a, 0e0) + coalesce(b, 0e0) + coalesce(c, 0e0)) / 2 ELSE coalesce(a, b, c) END
                                ELSE greatest(least(a, b), least(greatest(a, b), c)) END AS middle
                FROM (SELECT f.ticker, f.price, f.atr14, r.next_resistance, r.clear_resistance, {_A} AS a, {_B} AS b, {_C} AS c FROM features f LEFT JOIN resistances r ON r.ticker = f.ticker WHERE f.n >= 60) x) y) z""",
    (FEATURES, _RES),
)
_GROWTH = "coalesce(earnings_growth, revenue_growth)"
_FAIR = f"CASE WHEN {_GROWTH} > 0 THEN greatest(10e0, least(35e0, {_GROWTH} * 150)) ELSE 15e0 END"
_PE = "CASE WHEN forward_pe > 0 THEN forward_pe WHEN trailing_pe > 0 THEN trailing_pe END"
LONG = Rel(
    "long_targets",
    f"""
    SELECT ticker, (coalesce(wa * a, 0e0) + coalesce(wb * b, 0e0)) / nullif(CASE WHEN a IS NOT NULL THEN wa ELSE 0e0 END + CASE WHEN b IS NOT NULL THEN wb ELSE 0e0 END, 0) AS long_target
    FROM (SELECT ticker, a, CASE WHEN analysts >= 5 THEN 1.6e0 ELSE 0.9e0 END AS wa, CASE WHEN a IS NOT NULL THEN 0.7e0 ELSE 1.2e0 END AS wb,
                 CASE WHEN forward_eps > 0 THEN greatest(price * 0.70e0, least(price * 1.80e0, forward_eps * CASE WHEN pe IS NOT NULL THEN 0.5e0 * fair + 0.5e0 * pe ELSE fair END)) END AS b
          FROM (SELECT f.ticker, f.price, u.analysts, u.forward_eps, CASE WHEN u.target_mean_ratio > 0 THEN f.price * u.target_mean_ratio END AS a, {_FAIR} AS fair, {_PE} AS pe
                FROM features f JOIN fundamentals u ON u.ticker = f.ticker WHERE f.n >= 60) x) y""",
    (FEATURES, FUNDAMENTALS),
)
#: Stops of all securities; a position's entry replaces the price as their base.
STOPS = Rel(
    "stops",
    """
    SELECT ticker, price, atr14, base, initial_stop, chandelier, CASE WHEN chandelier < price THEN greatest(initial_stop, chandelier) ELSE initial_stop END AS active_stop
    FROM (SELECT *, coalesce(greatest(CASE WHEN s1 < price THEN s1 END, CASE WHEN s2 < price THEN s2 END, CASE WHEN s3 < price THEN s3 END), price - 2 * atr14) AS initial_stop, hi22 - 3 * atr14 AS chandelier
          FROM (SELECT f.ticker, f.price, f.atr14, f.hi22, coalesce(p.entry_price, f.price) AS base, coalesce(p.entry_price, f.price) - 2 * f.atr14 AS s1, w.dip - 0.4e0 * f.atr14 AS s2, CASE WHEN f.n >= 50 AND f.sma50 < f.price THEN f.sma50 * 0.97e0 END AS s3
                FROM features f LEFT JOIN positions p ON p.ticker = f.ticker
                LEFT JOIN (SELECT x.ticker, max(x.low) AS dip FROM short_swings x JOIN features y ON y.ticker = x.ticker WHERE x.is_low AND x.inner_bar AND x.low < y.price GROUP BY x.ticker) w ON w.ticker = f.ticker
                WHERE f.atr14 > 0 AND f.n >= 60) a) b""",
    (FEATURES, POSITIONS, SHORT_SWINGS),
)
_RANKING = RUN["ranking"]
#: Inputs of the sell rules: one row per position, with today's score where it is ranked.
WATCHED = Rel(
    "watched",
    """
    SELECT p.ticker, p.added_date, p.entry_price, p.quantity, p.score_at_entry, r.total_score AS score_now, f.price, f.n, f.last_date, f.hi252, f.lo252, f.sma20, f.sma50, f.sma150, f.sma200, f.slope_sma200, f.slope_obv, f.slope_close, f.rsi14, f.n_atr, f.atr10_now, f.atr_long,
           f.macd_now, f.macd_before, f.c1, f.c5, f.c21, s.active_stop, s.initial_stop, s.chandelier, s.atr14, t.short_target, l.long_target, u.days_to_earnings
    FROM positions p JOIN features f ON f.ticker = p.ticker JOIN short_targets t ON t.ticker = p.ticker LEFT JOIN long_targets l ON l.ticker = p.ticker LEFT JOIN stops s ON s.ticker = p.ticker
    LEFT JOIN fundamentals u ON u.ticker = p.ticker LEFT JOIN ranking r ON r.ticker = p.ticker""",
    (POSITIONS, FEATURES, SHORT, LONG, STOPS, FUNDAMENTALS, _RANKING),
)
#: Code -> (severity, condition).
RULES = {
    "STOP_HIT": (5, "price <= active_stop"),
    "STAGE4": (5, "n >= 200 AND price < sma200 AND slope_sma200 < 0"),
    "BELOW_MA150": (4, "n >= 150 AND price < sma150"),
    "SHORT_TARGET": (4, "price >= short_target"),
    "DISTRIBUTION": (4, "n > 60 AND slope_close > 0.05 AND slope_obv < -0.05"),
    "SCORE_DROPPED": (4, "score_at_entry - score_now >= 12"),
    "SCORE_WEAK": (2, "score_at_entry - score_now >= 6 AND score_at_entry - score_now < 12"),
    "BELOW_MA50": (3, "n >= 50 AND price < sma50"),
    "PARABOLIC": (3, "n >= 50 AND price / nullif(sma50, 0) - 1 > 0.40"),
    "OVERBOUGHT": (2, "rsi14 > 78"),
    "VOLATILE": (2, "n_atr > 90 AND atr10_now / nullif(atr_long, 0) > 1.5"),
    "MACD_CROSS": (2, "macd_now < 0 AND macd_before > 0"),
    "EARNINGS": (2, "days_to_earnings BETWEEN 0 AND 7"),
    "TARGETS_REVERSED": (2, "long_target < short_target"),
    "STOP_NEAR": (3, "price > active_stop AND 100 * (price / nullif(active_stop, 0) - 1) < 4"),
}
HITS = Rel("rule_hits", lambda q: "SELECT ticker, rule, severity FROM (SELECT ticker, " + q.stack(("rule", "severity", "hit"), [(f"'{c}'", str(s), f"coalesce({x}, FALSE)") for c, (s, x) in RULES.items()]) + " FROM watched) x WHERE hit", (WATCHED,))
_MAX, _SUM = "coalesce(max(h.severity), 0)", "coalesce(sum(h.severity), 0)"
RISK = Rel(
    "risk",
    f"""
    SELECT w.ticker, count(h.rule) AS n_rules, {_MAX} AS worst, {_SUM} AS severity,
           CASE WHEN {_MAX} >= 5 THEN 4 WHEN {_MAX} >= 4 OR {_SUM} >= 9 THEN 3 WHEN {_MAX} >= 3 OR {_SUM} >= 5 THEN 2 WHEN {_MAX} > 0 THEN 1 ELSE 0 END AS risk_index,
           CASE WHEN {_MAX} >= 5 THEN 'SELL' WHEN {_MAX} >= 4 OR {_SUM} >= 9 THEN 'HIGH_RISK' WHEN {_MAX} >= 3 OR {_SUM} >= 5 THEN 'CAUTION' WHEN {_MAX} > 0 THEN 'WATCH' ELSE 'SAFE' END AS risk
    FROM watched w LEFT JOIN rule_hits h ON h.ticker = w.ticker GROUP BY w.ticker""",
    (WATCHED, HITS),
)

CUTS = REG.cuts = (*CUTS, WATCHED)
REG.rel("tg_swings", "SELECT ticker, date, is_high, is_low FROM swings WHERE inner_bar AND (is_high OR is_low)", SWINGS)
REG.rel("tg_levels", "SELECT ticker, round(level, 5) AS level FROM levels", LEVELS)
REG.rel("tg_short", "SELECT ticker, round(next_resistance, 4) AS next_resistance, round(short_target, 5) AS short_target FROM short_targets", SHORT)
REG.rel("tg_long", "SELECT ticker, round(long_target, 5) AS long_target FROM long_targets", LONG)
REG.rel("tg_stops", "SELECT ticker, round(initial_stop, 5) AS initial_stop, round(chandelier, 5) AS chandelier, round(active_stop, 5) AS active_stop FROM stops", STOPS)
REG.rel("tg_sell_rules", "SELECT ticker, rule, severity FROM rule_hits", HITS)
REG.rel("tg_risk", "SELECT ticker, n_rules, worst, severity, risk_index, risk FROM risk", RISK)
_UP = "round(100 * ({} / nullif(w.price, 0) - 1), 5)"
#: A position's figures: gain, reward to risk, distance of targets and stop, averages of bars that are there, changes.
ANALYSIS = Rel(
    "analysis",
    f"""SELECT w.ticker, w.added_date, w.last_date, w.entry_price, w.quantity, w.price, w.n, w.active_stop, w.short_target, w.long_target, w.score_now, w.rsi14, w.atr14, w.hi252, w.lo252, r.n_rules, r.risk, r.risk_index,
              100 * (w.price / nullif(w.entry_price, 0) - 1) AS pnl_pct, CASE WHEN w.entry_price > w.active_stop THEN (w.short_target - w.price) / (w.entry_price - w.active_stop) END AS risk_reward,
              100 * (w.active_stop / nullif(w.entry_price, 0) - 1) AS stop_pnl_pct, {_UP.format("w.short_target")} AS short_upside_pct, {_UP.format("w.long_target")} AS long_upside_pct, 100 * w.atr14 / nullif(w.price, 0) AS atr_pct,
              {", ".join(f"CASE WHEN w.n >= {k} THEN w.sma{k} END AS ma{k}" for k in (20, 50, 150, 200))}, {", ".join(f"w.price / nullif(w.c{k}, 0) - 1 AS change_{k}" for k in (1, 5, 21))}
       FROM watched w JOIN risk r ON r.ticker = w.ticker""",
    (WATCHED, RISK),
)
REG.rel(
    "tg_analysis",
    "SELECT ticker, "
    + ", ".join(f"round({c}, 5) AS {c}" for c in ("pnl_pct", "risk_reward", "stop_pnl_pct", "rsi14", "ma20", "ma50", "ma150", "ma200", "atr14", "atr_pct", "hi252", "lo252", "change_1", "change_5", "change_21"))
    + ", round(score_now, 4) AS score_now, n_rules, risk, risk_index FROM analysis",
    ANALYSIS,
)
REG.rel(
    "tg_watch_history",
    """SELECT last_date AS date, ticker, added_date, quantity, round(price, 8) AS price, round(entry_price, 8) AS entry_price, round(pnl_pct, 5) AS pnl_pct, risk AS risk_level, n_rules AS signal_count, round(active_stop, 5) AS active_stop, round(stop_pnl_pct, 5) AS stop_pnl_pct,
              round(short_target, 5) AS short_target, short_upside_pct, round(long_target, 5) AS long_target, long_upside_pct, round(score_now, 4) AS total_score, round(rsi14, 5) AS rsi14, round(atr_pct, 5) AS atr_pct, risk_index,
              position FROM placed_analysis""",
    numbering("placed_analysis", ANALYSIS, "position", ("risk_index", "DESC"), ("ticker", "ASC")),
)
