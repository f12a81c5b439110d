"""Hand-written DuckDB statements of factors, independent of the expressions that Spark runs.

They share only the input tables with ``factors``: each says its rule in lists of (weight, part) or of checks.
"""

from __future__ import annotations

from rankloom.sources.adapters import BARS, EARNINGS, FUNDAMENTALS, INCOME

_INPUTS = f"""u AS ({FUNDAMENTALS.sql()}),
listed AS (SELECT ticker, arg_max(close, date) AS price FROM ({BARS.sql()}) b WHERE close IS NOT NULL GROUP BY ticker HAVING count(*) >= 30),
v AS (SELECT u.*, listed.price FROM u JOIN listed USING (ticker))"""


def _over(columns: str, value: str, more: str = "", source: str = "v") -> str:
    return f"WITH {_INPUTS}{more} SELECT ticker, round({value}, 6) AS value FROM (SELECT *, {columns} FROM {source}) t"


def _mean(parts: str) -> str:
    """Weighted mean of a list of {{'w', 'x'}} whose x is known."""
    known = f"list_filter({parts}, lambda p: p.x IS NOT NULL)"
    return f"CASE WHEN len({known}) > 0 THEN list_sum(list_transform({known}, lambda p: p.w * p.x)) / list_sum(list_transform({known}, lambda p: p.w)) END"


def _held(low: str, high: str, x: str) -> str:
    return f"CASE WHEN ({x}) < {low} THEN {low} WHEN ({x}) > {high} THEN {high} ELSE ({x}) END"


SQL = {
    "financial_health": _over(
        """list_filter([current_ratio > 1.2, debt_to_equity < 100, free_cashflow > 0, net_income > 0, operating_margin > 0, operating_cashflow > net_income, quick_ratio > 1,
           CASE WHEN total_debt > 0 THEN total_cash * 2 > total_debt END, revenue_growth > 0], lambda c: c IS NOT NULL) AS checks""",
        "CASE WHEN len(checks) < 3 THEN NULL ELSE len(list_filter(checks, lambda c: c)) * 100.0 / len(checks) END",
    ),
    "rule_of_40": _over(
        "[CASE WHEN total_revenue > 0 THEN free_cashflow / total_revenue END, operating_margin, profit_margin, ebitda_margin] AS margins",
        _held("-1.5", "1.5", "((revenue_growth + list_filter(margins, lambda m: m IS NOT NULL)[1]) * 100 - 40) / 30"),
    ),
    "analyst_upside": _over(
        f"""[{{'w': 1.5, 'x': {_held("-1.0", "1.5", "(target_mean_ratio - 1) * 4")}}},
             {{'w': 1.0, 'x': CASE WHEN target_high_ratio > target_low_ratio AND 1 - target_low_ratio > 0
                                   THEN {_held("-1.0", "1.0", "((target_high_ratio - 1) - (1 - target_low_ratio)) / ((target_high_ratio - 1) + (1 - target_low_ratio)) / 0.4")} END}}] AS parts""",
        f"CASE WHEN price > 0 AND target_mean_ratio IS NOT NULL THEN {_mean('parts')} END",
    ),
    "revenue_scaling": _over(
        f"""[{{'w': 2.0, 'x': {_held("-1.5", "1.5", "revenue_growth * 4")}}},
             {{'w': 1.2, 'x': CASE WHEN len(r) >= 5 AND r[5] > 0 THEN {_held("-1.5", "1.5", "(r[1] / r[5] - 1) * 4")} END}},
             {{'w': 1.5, 'x': CASE WHEN len(r) >= 6 AND r[5] > 0 AND r[6] > 0 THEN {_held("-1.0", "1.0", "((r[1] / r[5] - 1) - (r[2] / r[6] - 1)) * 10")} END}},
             {{'w': 0.8, 'x': {_held("-1.0", "1.5", "est_revenue_next * 4")}}}] AS parts""",
        _mean("parts"),
        f", q AS (SELECT ticker, list(value ORDER BY quarter DESC) AS r FROM ({INCOME.sql()}) i GROUP BY ticker), vq AS (SELECT * FROM v LEFT JOIN q USING (ticker))",
        "vq",
    ),
    "institutional_ownership": _over(
        "[1 - abs(CASE WHEN held_institutions > 1 THEN 1 ELSE held_institutions END - 0.675) / 0.675, CASE WHEN held_insiders > 0.1 THEN 0.5 ELSE held_insiders * 5 END] AS parts",
        "list_sum(list_filter(parts, lambda p: p IS NOT NULL))",
    ),
    "cash_runway": _over(
        "CASE WHEN free_cashflow IS NULL THEN operating_cashflow ELSE free_cashflow END AS flow, total_cash / CASE WHEN total_debt > 0 THEN total_debt END AS cover",
        f"""CASE WHEN flow IS NULL THEN NULL WHEN flow > 0 AND cover IS NULL THEN 1.0 WHEN flow > 0 AND cover >= 1.6 THEN 1.5 WHEN flow > 0 THEN 0.7 + cover / 2
             WHEN total_cash IS NULL OR total_cash <= 0 THEN -1.2 ELSE {_held("-1.5", "0.8", "(total_cash / -nullif(flow, 0) - 1.5) / 1.5")} END""",
    ),
    "earnings_surprise": _over(
        f"list_transform(s, lambda x: {_held('-0.25', '0.25', 'x')}) AS held",
        """CASE len(held) WHEN 0 THEN NULL WHEN 1 THEN held[1] WHEN 2 THEN (2 * held[1] + held[2]) / 3 WHEN 3 THEN (2 * held[1] + 1.5 * held[2] + held[3]) / 4.5
           ELSE (6 * held[1] + 5 * held[2] + 4 * held[3] + 3 * held[4]) / 18 END""",
        f", e AS (SELECT ticker, (list(surprise ORDER BY quarter DESC) FILTER (WHERE surprise IS NOT NULL))[1:4] AS s FROM ({EARNINGS.sql()}) h GROUP BY ticker), ve AS (SELECT v.ticker, e.s FROM v LEFT JOIN e USING (ticker))",
        "ve",
    ),
}
