"""Factor values per security: one row per ticker from bar features, fundamentals, estimates, ratings and mentions.

Each factor is a registered relation of (ticker, value); ``FACTORS`` joins them all into one wide row, and
``FACTOR_VALUES`` is the long form that scoring reads. A missing input leaves a factor null.
"""

from __future__ import annotations

import re

from rankloom.functions.expr import cap, clamp, d, floor_at, wavg
from rankloom.operators.profile import CUTS, FEATURE_COLUMNS, FEATURES, TAIL
from rankloom.operators.signals import SUMMARY
from rankloom.plans.rel import Rel, Registry
from rankloom.sources.adapters import BENCH, EARNINGS, ESTIMATES, FIGURES, FUNDAMENTALS, INCOME, MENTIONS, RATINGS, SECURITIES

REG = Registry()


#: Closes of the benchmark on each ticker's own days, counted back from its last one.
RELATIVE = Rel(
    "relative",
    lambda q: "SELECT ticker, count(*) AS n_joined, " + ", ".join(f"max(CASE WHEN jr = {k + 1} THEN close END) AS s{k}, max(CASE WHEN jr = {k + 1} THEN bench_close END) AS b{k}" for k in (0, 63, 126, 189, 252))
    + f" FROM (SELECT {q.small('y')}x.ticker, x.close, y.bench_close, row_number() OVER (PARTITION BY x.ticker ORDER BY x.date DESC) AS jr FROM bars x JOIN bench y ON x.date = y.date WHERE x.close IS NOT NULL AND y.bench_close IS NOT NULL) j GROUP BY ticker",
    (BENCH,),
)

_QUARTERS = Rel("quarters", "SELECT ticker, count(*) AS n_quarters, " + ", ".join(f"max(CASE WHEN quarter_rank = {k + 1} THEN value END) AS q{k}" for k in (0, 1, 4, 5)) + " FROM income GROUP BY ticker", (INCOME,))


def _change(now: str, old: str) -> str:
    return clamp(-1, 1, f"CASE WHEN abs({old}) > 1e-6 THEN ({now} - {old}) / abs({old}) / 0.10e0 END")


_REVISIONS = Rel(
    "revisions",
    "SELECT ticker, " + ", ".join(f"max(CASE WHEN period = '{p}' THEN {_change('eps_now', old)} END) AS {n}" for p, old, n in (("0y", "eps_30d", "r0_30"), ("0y", "eps_90d", "r0_90"), ("+1y", "eps_30d", "r1_30"), ("+1y", "eps_90d", "r1_90")))
    + ", sum(coalesce(up_30d, 0)) AS ups, sum(coalesce(down_30d, 0)) AS downs FROM estimates GROUP BY ticker",
    (ESTIMATES,),
)
_RATING = Rel(
    "rating_means",
    """SELECT ticker, max(CASE WHEN period = '0m' THEN m END) AS rating_now, max(CASE WHEN period = '-3m' THEN m END) AS rating_old
    FROM (SELECT ticker, period, (strong_buy + 2 * buy + 3 * hold + 4 * sell + 5 * strong_sell) / nullif(cast(strong_buy + buy + hold + sell + strong_sell AS double), 0) AS m FROM ratings) x GROUP BY ticker""",
    (RATINGS,),
)
#: Weighted mean of the last four known surprises, later ones heavier (1 to 2 in even steps).
_SURPRISE = Rel(
    "surprises",
    """SELECT ticker, sum(weight * greatest(-0.25e0, least(0.25e0, surprise))) / sum(weight) AS surprise
    FROM (SELECT ticker, surprise, 1 + CASE WHEN least(k, 4) > 1 THEN (least(k, 4) - back) / (least(k, 4) - 1e0) ELSE 0e0 END AS weight, back
          FROM (SELECT ticker, surprise, row_number() OVER (PARTITION BY ticker ORDER BY quarter DESC) AS back, count(*) OVER (PARTITION BY ticker) AS k FROM earnings_history WHERE surprise IS NOT NULL) x) y
    WHERE back <= 4 GROUP BY ticker""",
    (EARNINGS,),
)
_BUZZ = Rel("buzz", "SELECT ticker, mentions, mentions_prev, rank AS mention_rank, sentiment_score FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS r FROM mentions) x WHERE r = 1", (MENTIONS,))

#: Which columns each relation gives to a factor's inputs.
_GIVES: tuple[tuple[Rel, tuple[str, ...]], ...] = (
    (FEATURES, tuple(FEATURE_COLUMNS)),
    (RELATIVE, ("n_joined", *(f"{x}{k}" for k in (0, 63, 126, 189, 252) for x in "sb"))),
    (_QUARTERS, ("n_quarters", "q0", "q1", "q4", "q5")),
    (TAIL, ("trend_r2", "vol252", "max_drawdown252")),
    (SUMMARY, ("technical_score",)),
    (_REVISIONS, ("r0_30", "r0_90", "r1_30", "r1_90", "ups", "downs")),
    (_RATING, ("rating_now", "rating_old")),
    (_SURPRISE, ("surprise",)),
    (_BUZZ, ("mentions", "mentions_prev", "mention_rank", "sentiment_score")),
    (FUNDAMENTALS, ("market_cap", "free_cashflow", "operating_cashflow", "total_debt", "total_cash", "total_revenue", "net_income", "days_to_earnings", *(c for c in FIGURES if not c.endswith("_share")))),
)


def inputs(name: str, *formulas: str) -> Rel:
    """Securities with 30 bars, joined with just the relations whose columns the formulas use."""
    words = set(re.findall(r"\w+", " ".join(formulas)))
    used = [(r, c) for r, c in _GIVES if r is FEATURES or words & set(c)]
    columns = ", ".join(f"{r.name}.{c}" for r, own in used for c in own if c in words)
    joins = " ".join(f"{'' if r is FEATURES else 'LEFT '}JOIN {r.name} ON {r.name}.ticker = s.ticker" for r, _ in used)
    return Rel(name, f"SELECT s.ticker, s.name, s.sector, s.industry{', ' + columns if columns else ''} FROM securities s {joins} WHERE features.n >= 30", (SECURITIES, *(r for r, _ in used)))


def _points(*tests: str) -> str:
    return " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in tests)


_MA200 = "CASE WHEN n >= 200 THEN sma200 ELSE avg_all_but_first END"
_FLOW = "coalesce(free_cashflow, operating_cashflow)"
#: Check of financial health -> the inputs that must be known for it to count.
_HEALTH = {
    "current_ratio > 1.2": "current_ratio", "debt_to_equity < 100": "debt_to_equity", "free_cashflow > 0": "free_cashflow", "net_income > 0": "net_income", "operating_margin > 0": "operating_margin",
    "operating_cashflow > net_income": "operating_cashflow + net_income", "quick_ratio > 1": "quick_ratio", "total_cash > 0.5e0 * total_debt": "total_cash + CASE WHEN total_debt > 0 THEN total_debt END", "revenue_growth > 0": "revenue_growth",
}
_KNOWN = _points(*(f"({x}) IS NOT NULL" for x in _HEALTH.values()))
_PASSED = _points(*(f"{t} AND ({x}) IS NOT NULL" for t, x in _HEALTH.items()))
_MARGIN = "coalesce(CASE WHEN total_revenue > 0 THEN free_cashflow / total_revenue END, operating_margin, profit_margin, ebitda_margin)"
_DV = "price * vol30"


def _mean(*x: str) -> str:
    return wavg(*((1, v) for v in x))


#: Factor id -> value over ``factor_inputs``.
FORMULAS = {
    "price_momentum_12_1": "CASE WHEN n >= 260 THEN c21 / nullif(c251, 0) - 1 END",
    "relative_strength": "CASE WHEN n_joined >= 70 THEN " + wavg(*((w, f"s0 / nullif(s{k}, 0) - b0 / nullif(b{k}, 0)") for k, w in ((63, 2), (126, 1), (189, 1), (252, 1)))) + " END",
    "trend_structure": f"CASE WHEN n >= 150 THEN 12.5e0 * ({_points(f'price > sma150 AND price > {_MA200}', f'sma150 > {_MA200}', 'slope_sma200 > 0', f'sma50 > sma150 AND sma50 > {_MA200}', 'price > sma50', 'lo252 > 0 AND price >= lo252 * 1.30e0', 'hi252 > 0 AND price >= hi252 * 0.75e0', 'slope_sma50 > 0')}) END",
    "breakout_setup": "CASE WHEN n >= 130 THEN " + wavg((1.5, "CASE WHEN n_width > 40 THEN 1 - 2 * width_pct END"), (1.2, clamp(-1, 1, "(0.22e0 - (hi30 - lo30) / nullif(mean30, 0)) / 0.14e0")), (1.3, clamp(-1, 1, "(price / nullif(hi63, 0) - 1 + 0.04e0) / 0.04e0")), (1.0, clamp(-1, 1, "CASE WHEN n_atr > 90 AND atr_long > 0 THEN (1 - atr_short / atr_long) / 0.25e0 END"))) + " END",
    "size_opportunity": f"CASE WHEN market_cap > 0 THEN greatest(-1.5e0, least(1e0, 1 - power((log10(market_cap) - 9.18e0) / 0.95e0, 2) - CASE WHEN market_cap < 1.5e8 THEN 0.6e0 ELSE 0e0 END)) END",
    "revenue_scaling": wavg((2.0, clamp(-1.5, 1.5, "revenue_growth / 0.25e0")), (1.2, clamp(-1.5, 1.5, "CASE WHEN n_quarters >= 5 AND q4 > 0 THEN (q0 / q4 - 1) / 0.25e0 END")), (1.5, clamp(-1, 1, "CASE WHEN n_quarters >= 6 AND q4 > 0 AND q5 > 0 THEN (q0 / q4 - q1 / q5) / 0.10e0 END")), (0.8, clamp(-1, 1.5, "est_revenue_next / 0.25e0"))),
    "rule_of_40": clamp(-1.5, 1.5, f"(100 * (revenue_growth + {_MARGIN}) - 40) / 30e0"),
    "undiscovered": wavg((1.0, "CASE WHEN analysts <= 0 THEN -0.7e0 END"), (1.2, "CASE WHEN analysts > 0 THEN CASE WHEN analysts <= 12 THEN 1 - abs(analysts - 7) / 9e0 ELSE greatest(-1e0, 0.55e0 - (analysts - 12) / 22e0) END END"), (1.0, "CASE WHEN held_institutions < 0.05 THEN -0.5e0 END"), (1.3, "CASE WHEN held_institutions >= 0.05 THEN 1 - abs(least(held_institutions, 1e0) - 0.45e0) / 0.45e0 END"), (0.7, clamp(-0.5, 1, "held_insiders / 0.15e0"))),
    "cash_runway": f"CASE WHEN {_FLOW} > 0 THEN CASE WHEN total_debt > 0 AND total_cash IS NOT NULL THEN least(1.5e0, 0.7e0 + 0.5e0 * least(2e0, total_cash / total_debt)) ELSE 1e0 END WHEN {_FLOW} <= 0 THEN CASE WHEN total_cash IS NULL OR total_cash <= 0 THEN -1.2e0 ELSE {clamp(-1.5, 0.8, f'(total_cash / nullif(abs({_FLOW}), 0) - 1.5e0) / 1.5e0')} END END",
    "stage2_breakout": "CASE WHEN n >= 200 THEN CASE WHEN NOT coalesce(price > sma150, FALSE) THEN -1e0 ELSE " + wavg((1.0, "CASE WHEN slope_sma150 > 0 THEN 1e0 ELSE -0.2e0 END"), (1.4, "CASE WHEN days_above < 15 THEN 0.15e0 WHEN days_above <= 160 THEN 1 - abs(days_above - 70) / 130e0 ELSE greatest(-1e0, 0.45e0 - (days_above - 160) / 220e0) END"), (1.2, clamp(-1, 1, "CASE WHEN days_above < n - 60 AND pre_n >= 60 THEN (0.62e0 - (pre_max - pre_min) / nullif(pre_avg, 0)) / 0.27e0 END")), (0.9, clamp(-1, 1, "CASE WHEN lo252 > 0 AND hi252 > lo252 THEN (1.30e0 - (price / lo252 - 1)) / 0.9e0 END"))) + " END END",
    "chart_position": "CASE WHEN n >= 130 AND hi252 > lo252 THEN " + wavg((1.5, clamp(-1.2, 1, "1 - abs((price - lo252) / (hi252 - lo252) - 0.77e0) / 0.30e0")), (0.8, clamp(-1, 1, "CASE WHEN all_hi > 0 THEN (0.30e0 - abs(all_hi / nullif(price, 0) - 1 - 0.12e0)) / 0.25e0 END"))) + " END",
    "analyst_upside": "CASE WHEN price > 0 AND target_mean_ratio IS NOT NULL THEN " + wavg((1.5, clamp(-1, 1.5, "(target_mean_ratio - 1) / 0.25e0")), (1.0, clamp(-1, 1, "CASE WHEN target_high_ratio > target_low_ratio AND target_low_ratio < 1 THEN (target_high_ratio + target_low_ratio - 2) / nullif(target_high_ratio - target_low_ratio, 0) / 0.4e0 END"))) + " END",
    "momentum_persistence": "CASE WHEN n >= 130 THEN " + wavg((1.6, clamp(-1, 1, "trend_r2 / 0.6e0")), (0.8, clamp(-1, 1, "CASE WHEN n_ret > 60 THEN (win_rate - 0.5e0) / 0.06e0 END")), (0.7, floor_at(-1, "CASE WHEN n_ret > 60 THEN 1 - jump_rate / 0.06e0 END")), (0.9, clamp(-1, 1, "CASE WHEN n_rm > 60 THEN (high_rate - 0.06e0) / 0.12e0 END"))) + " END",
    "volume_accumulation": "CASE WHEN n >= 60 THEN slope_obv + 8 * (vol20 / nullif(vol60, 0) - 1) END",
    "eps_revision_momentum": _mean("r0_30", "0.6e0 * r0_90", "r1_30", "0.6e0 * r1_90", "1.4e0 * (ups - downs) / nullif(ups + downs, 0)", f"1.2e0 * {clamp(-1, 1, '(rating_old - rating_now) / 0.30e0')}"),
    "analyst_consensus": "3 + (rating_mean - 3) * CASE WHEN analysts IS NULL OR analysts <= 0 THEN 0.4e0 ELSE least(1e0, analysts / 5e0) END",
    "earnings_surprise": "surprise",
    "quality_profitability": _mean(*(clamp(-1, 2, f"{c} / {d(g)}") for c, g in (("roe", 0.2), ("roa", 0.08), ("gross_margin", 0.4), ("operating_margin", 0.15), ("profit_margin", 0.1)))),
    "valuation_composite": wavg(*((w, clamp(-1, 2, f"CASE WHEN {c} > 0 THEN {d(fair)} / {c} - 1 END")) for c, fair, w in (("forward_pe", 18, 1.4), ("trailing_pe", 20, 1), ("ev_ebitda", 12, 1.2), ("price_to_sales", 2.5, 0.8), ("price_to_book", 3, 0.6), ("peg", 1.5, 1))), (1.5, clamp(-1, 2, "free_cashflow / nullif(market_cap, 0) / 0.05e0"))),
    "financial_health": f"CASE WHEN {_KNOWN} >= 3 THEN 100e0 * ({_PASSED}) / ({_KNOWN}) END",
    "growth_quality": wavg((1, clamp(-1.5, 2, "revenue_growth / 0.15e0")), (1.2, clamp(-1.5, 2, "earnings_growth / 0.20e0")), (0.8, clamp(-1.5, 2, "earnings_q_growth / 0.20e0")), (1, clamp(-1.5, 2, "est_growth_next / 0.15e0")), (0.8, clamp(-1, 1, "(est_growth_next - est_growth_now) / 0.10e0"))),
    "risk_drawdown": _mean(clamp(-1.5, 1.5, "(0.25e0 - vol252) / 0.20e0"), clamp(-1.5, 1.5, "(max_drawdown252 + 0.25e0) / 0.20e0"), clamp(-1.5, 1.5, "(1.10e0 - beta) / 0.45e0")),
    "liquidity": f"CASE WHEN {_DV} > 0 THEN " + wavg((1.5, clamp(-1.5, 1.5, f"CASE WHEN market_cap > 0 THEN ({_DV} / market_cap - 0.005e0) / 0.006e0 END")), (1.0, clamp(-1.5, 1, f"(log10({_DV}) - log10(250000e0)) / (log10(5000000e0) - log10(250000e0))"))) + " END",
    "short_squeeze": _mean(cap(1.5, "short_percent / 0.10e0"), cap(1.5, "short_ratio / 5e0")),
    "institutional_ownership": "CASE WHEN coalesce(held_institutions, held_insiders) IS NOT NULL THEN coalesce(1 - abs(least(held_institutions, 1e0) - 0.675e0) / 0.675e0, 0e0) * CASE WHEN held_institutions IS NULL THEN 0 ELSE 1 END + CASE WHEN held_insiders IS NULL THEN 0e0 ELSE 0.5e0 * least(1e0, held_insiders / 0.10e0) END END",
    "nominal_price_fit": "price",
    "technical_oscillators": "technical_score",
    "reddit_wsb_attention": "CASE WHEN mentions > 0 THEN greatest(0e0, least(100e0, 0.5e0 * CASE WHEN mentions_prev > 0 THEN 50 + 50 * greatest(-1e0, least(1e0, (mentions - mentions_prev) / cast(mentions_prev AS double) / 2)) WHEN mentions_prev = 0 THEN 90e0 ELSE 50e0 END"
    " + 0.3e0 * 100 * least(1e0, ln(1e0 + mentions) / ln(201e0)) + 0.2e0 * CASE WHEN sentiment_score IS NOT NULL THEN 50 + 50 * greatest(-1e0, least(1e0, sentiment_score / 0.3e0)) ELSE 50e0 END)) END",
}

_IDENTITY = ("ticker", "name", "sector", "industry", "last_date", "n", "price", "market_cap", "rsi14", "days_to_earnings", "mention_rank", "beta", "debt_to_equity")
#: Penalty id -> condition over the factor row.
PENALTIES = {
    "parabolic_extension": "n >= 50 AND price / nullif(sma50, 0) - 1 > 0.40",
    "hype_reversal_risk": "rsi14 > 75 AND mention_rank <= 10",
    "earnings_imminent": "days_to_earnings BETWEEN 0 AND 7",
    "negative_fcf_high_debt": "free_cashflow < 0 AND debt_to_equity > 150",
    "distribution_pattern": "slope_close > 0.05 AND slope_obv < -0.05",
}
_DERIVED = [f"CASE WHEN n > {k} THEN price / nullif(c{k}, 0) - 1 END AS return_{m}" for k, m in ((21, "1m"), (63, "3m"), (126, "6m"), (252, "12m"))]
ALL = inputs("factor_inputs", *FORMULAS.values(), *PENALTIES.values(), *_IDENTITY, *_DERIVED, _DV, "sma50")
FACTORS = Rel(
    "factors",
    "SELECT " + ", ".join(_IDENTITY) + f", {_DV} AS dollar_volume, " + ", ".join(f"{x} AS {f}" for f, x in FORMULAS.items())
    + ", " + ", ".join(_DERIVED)
    + ", " + ", ".join(f"coalesce({x}, FALSE) AS penalty_{p}" for p, x in PENALTIES.items())
    + f", CASE WHEN n >= 50 AND sma50 > 0 THEN 100 * (price / sma50 - 1) END AS extension_pct, CASE WHEN market_cap > 0 THEN {_DV} / market_cap END AS turnover, 0.05e0 * ({_DV}) AS max_position, "
    + "CASE WHEN market_cap <= 0 OR market_cap IS NULL THEN NULL WHEN market_cap < 3e8 THEN 'micro' WHEN market_cap < 2e9 THEN 'small' WHEN market_cap < 1e10 THEN 'mid' WHEN market_cap < 5e10 THEN 'large' ELSE 'mega' END AS cap_band"
    + " FROM factor_inputs",
    (ALL,),
)

FACTOR_VALUES = Rel("factor_values", lambda q: "SELECT ticker, sector, " + q.stack(("factor_id", "raw"), [(f"'{f}'", f"cast({f} AS double)") for f in FORMULAS]) + " FROM factors", (FACTORS,))
PENALTY_FLAGS = Rel("penalty_flags", lambda q: "SELECT ticker, penalty_id FROM (SELECT ticker, " + q.stack(("penalty_id", "hit"), [(f"'{p}'", f"penalty_{p}") for p in PENALTIES]) + " FROM factors) x WHERE hit", (FACTORS,))

CUTS = REG.cuts = (*CUTS, FACTORS)
for _f, _x in FORMULAS.items():
    REG.rel(f"fa_{_f}", f"SELECT ticker, round({_x}, 6) AS value FROM inputs_{_f}", inputs(f"inputs_{_f}", _x))
REG.rel("fa_returns", "SELECT ticker, " + ", ".join(f"round({x.split(' AS ')[0]}, 6) AS {x.split(' AS ')[1]}" for x in _DERIVED) + " FROM inputs_returns", inputs("inputs_returns", *_DERIVED))
REG.rel("fa_penalty_flags", "SELECT ticker, penalty_id FROM penalty_flags", PENALTY_FLAGS)
REG.rel("fa_record", "SELECT " + ", ".join(c if c in ("ticker", "name", "sector", "industry", "last_date", "n", "mention_rank") else f"round({c}, 8) AS {c}" if c in ("price", "rsi14") else f"round({c}, 1) AS {c}" if c == "market_cap" else f"round({c}, 3) AS {c}" for c in _IDENTITY) + ", round(dollar_volume, 2) AS dollar_volume, round(extension_pct, 5) AS extension_pct, round(turnover, 8) AS turnover, round(max_position, 2) AS max_position, cap_band FROM factors", FACTORS)
