"""Hand-written DuckDB statements of scoring, stops and targets, independent of the steps that Spark runs.

They share the input tables (factor values, flags, bars, fundamentals, positions) and the default configuration's
figures. Percentiles come from cumulated counts of distinct values, bands from lists, ranges and swings from a
ticker's bars as lists.
"""

from __future__ import annotations

from rankloom.operators.factors import FACTOR_VALUES, PENALTY_FLAGS
from rankloom.operators.scoring import DEFAULT, SCORE_DIGITS
from rankloom.sources.adapters import BARS, FUNDAMENTALS, POSITIONS


def _list(items) -> str:
    return "[" + ", ".join(items) + "]"


def _or_null(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(float(x))


_BUDGET = {m: (c, b) for c, b, members in DEFAULT.clusters for m in members}
_FACTORS = ", ".join(
    f"('{f.id}', '{f.category}', '{f.norm}', {f.lower_better}, {f.weight}, {_or_null(_BUDGET.get(f.id, (None,))[0])}, {_or_null(_BUDGET.get(f.id, (None, None))[1])}, "
    f"{_list(f'{{bound: {float(b)!r}, points: {float(s)!r}}}' for b, s, _ in f.bands)}::STRUCT(bound DOUBLE, points DOUBLE)[])"
    for f in DEFAULT.factors
)
_PENALTIES = ", ".join(f"('{p}', {_or_null(s)}, {float(points)!r})" for p, (s, points) in DEFAULT.penalties.items())

_SCORING = f"""given AS ({FACTOR_VALUES.sql()}),
flagged AS ({PENALTY_FLAGS.sql()}),
f(factor_id, category, norm, lower_better, weight, grp, budget, steps) AS (VALUES {_FACTORS}),
size AS (SELECT count(DISTINCT ticker) AS all_tickers FROM given),
known AS (SELECT factor_id, count(*) AS n FROM given WHERE raw IS NOT NULL GROUP BY factor_id),
cover AS (SELECT f.*, coalesce(n, 0) AS n, coalesce(n, 0) / all_tickers AS share FROM f JOIN (SELECT DISTINCT factor_id FROM given) USING (factor_id) LEFT JOIN known USING (factor_id) CROSS JOIN size),
ladder AS (SELECT factor_id, raw::FLOAT AS step, count(*) AS equal, sum(count(*)) OVER (PARTITION BY factor_id ORDER BY raw::FLOAT) AS upto FROM given WHERE raw IS NOT NULL GROUP BY factor_id, raw::FLOAT),
placed AS (SELECT ticker, sector, g.raw, c.*, CASE WHEN g.raw IS NULL THEN NULL WHEN n = 1 THEN 50.0 ELSE (upto - (equal - 1) / 2) * 100 / n END AS pct
           FROM given g JOIN cover c USING (factor_id) LEFT JOIN ladder l ON l.factor_id = g.factor_id AND l.step = g.raw::FLOAT),
aimed AS (SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN norm = 'raw' THEN least(greatest(raw, 0), 100)
                         WHEN norm = 'band' THEN coalesce(list_filter(steps, lambda s: raw <= s.bound)[1], steps[-1]).points
                         WHEN lower_better THEN 100 - pct ELSE pct END AS aim
          FROM placed WHERE share >= {DEFAULT.min_coverage}),
sectors AS (SELECT factor_id, sector, avg(aim) AS middle, stddev_pop(aim) AS spread FROM aimed WHERE norm = 'rank' AND category != 'preference' GROUP BY factor_id, sector HAVING count(aim) >= 5 AND stddev_pop(aim) >= 1e-9),
scored AS (SELECT a.*, CASE WHEN spread IS NULL OR aim IS NULL THEN aim ELSE least(greatest(50 + (aim - middle) / spread * 15, 0), 100) END AS points
           FROM aimed a LEFT JOIN sectors s ON s.factor_id = a.factor_id AND s.sector IS NOT DISTINCT FROM a.sector),
groups AS (SELECT grp, sum(weight) AS before FROM cover WHERE grp IS NOT NULL AND share >= {DEFAULT.min_coverage} GROUP BY grp HAVING count(*) > 1),
heavy AS (SELECT c.*, weight * coalesce(budget / before, 1) AS own FROM cover c LEFT JOIN groups USING (grp) WHERE share >= {DEFAULT.min_coverage}),
parts AS (SELECT *, own / (SELECT sum(own) FROM heavy) * 100 AS part FROM heavy),
sums AS (SELECT ticker, any_value(sector) AS sector, sum(points * part) / sum(part) AS plain, least(sum(part) / 100, 1.0) AS share FROM scored JOIN (SELECT factor_id, part FROM parts) USING (factor_id) WHERE points IS NOT NULL GROUP BY ticker),
bases AS (SELECT ticker, coalesce(s.sector, g.sector) AS sector, plain, coalesce(share, 0.0) AS share, 50 + (plain - 50) * share AS base FROM (SELECT ticker, any_value(sector) AS sector FROM given GROUP BY ticker) g LEFT JOIN sums s USING (ticker)),
unit AS (SELECT CASE WHEN stddev_pop(base) >= 1e-6 THEN stddev_pop(base) ELSE 1.0 END AS sigma FROM bases),
fines AS (SELECT ticker, count(*) AS n_fines, sum(CASE WHEN s IS NULL THEN points / sigma ELSE s END) AS fine FROM flagged JOIN (VALUES {_PENALTIES}) p(penalty_id, s, points) USING (penalty_id) CROSS JOIN unit GROUP BY ticker),
results AS (SELECT b.*, sigma, coalesce(n_fines, 0) AS n_fines, sigma * greatest(coalesce(fine, 0), -{DEFAULT.penalty_cap}) AS fined FROM bases b CROSS JOIN unit LEFT JOIN fines USING (ticker)),
totals AS (SELECT *, least(greatest(base + fined, 0), 100) AS total FROM results WHERE share >= {DEFAULT.min_include})"""

_LISTS = f"""listed AS (SELECT ticker, list(close ORDER BY date) AS c, list(high ORDER BY date) AS h, list(low ORDER BY date) AS l, len(c) AS n FROM ({BARS.sql()}) b WHERE close IS NOT NULL GROUP BY ticker HAVING count(*) >= 60),
ranged AS (SELECT *, c[-1] AS price, list_transform(range(1, n + 1), lambda i: CASE WHEN i = 1 THEN h[1] - l[1] ELSE list_max([h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])]) END) AS tr FROM listed),
basic AS (SELECT *, list_reduce(tr, lambda s, x: s + (x - s) / 14) AS atr, CASE WHEN n < 126 THEN n ELSE 126 END AS reach FROM ranged)"""

SQL = {
    "sc_percentile": f"WITH {_SCORING} SELECT ticker, factor_id, round(share, 6) AS coverage, round(pct, 6) AS percentile FROM placed",
    "sc_normalised": f"WITH {_SCORING} SELECT ticker, factor_id, round(aim, 6) AS directed, round(points, 5) AS score FROM scored",
    "sc_weights": f"WITH {_SCORING} SELECT factor_id, category, grp AS cluster, round(weight::DOUBLE, 6) AS weight, round(part, 6) AS w, round(share, 4) AS coverage FROM parts",
    "sc_base": f"WITH {_SCORING} SELECT ticker, round(plain, 5) AS base_raw, round(share, 6) AS coverage, round(base, 5) AS base FROM bases",
    "sc_penalties": f"WITH {_SCORING} SELECT ticker, n_fines AS n_penalties, round(sigma, 5) AS sigma, round(fined, 5) AS penalty FROM results",
    "sc_ranking": f"""WITH {_SCORING} SELECT ticker, sector, round(base, 5) AS base, round(fined, 5) AS penalty, round(total, 5) AS total_score, round(share, 6) AS coverage, share < {DEFAULT.min_confidence} AS low_confidence,
        row_number() OVER (ORDER BY round(total, {SCORE_DIGITS}) DESC, ticker) AS rank FROM totals""",
    "tg_stops": f"""WITH {_LISTS}, bought AS ({POSITIONS.sql()}),
        dips AS (SELECT *, CASE WHEN reach >= 24 THEN list_max(list_filter(list_transform(list_filter(range(n - reach + 9, n - 7), lambda i: l[i] = list_min(l[i - 8:i + 8])), lambda i: l[i]), lambda x: x < price)) END AS dip FROM basic),
        below AS (SELECT ticker, price, atr, list_filter([coalesce(entry_price, price) - 2 * atr, dip - 0.4 * atr, CASE WHEN list_avg(c[-50:]) < price THEN 0.97 * list_avg(c[-50:]) END], lambda x: x < price) AS stops, list_max(c[-22:]) - 3 * atr AS trail
                  FROM dips LEFT JOIN (SELECT ticker, entry_price FROM bought) USING (ticker) WHERE atr > 0),
        first AS (SELECT *, CASE WHEN len(stops) > 0 THEN list_max(stops) ELSE price - 2 * atr END AS start FROM below)
        SELECT ticker, round(start, 5) AS initial_stop, round(trail, 5) AS chandelier, round(CASE WHEN trail < price AND trail > start THEN trail ELSE start END, 5) AS active_stop FROM first""",
    "tg_long": f"""WITH {_LISTS}, u AS ({FUNDAMENTALS.sql()}),
        seen AS (SELECT u.*, b.price, CASE WHEN earnings_growth IS NULL THEN revenue_growth ELSE earnings_growth END AS growth, list_filter([forward_pe, trailing_pe], lambda x: x > 0)[1] AS multiple FROM basic b JOIN u USING (ticker)),
        fair AS (SELECT *, CASE WHEN growth > 0 THEN least(greatest(150 * growth, 10), 35) ELSE 15 END AS due FROM seen),
        views AS (SELECT ticker, list_filter([{{'w': CASE WHEN analysts >= 5 THEN 1.6 ELSE 0.9 END, 'x': CASE WHEN target_mean_ratio > 0 THEN price * target_mean_ratio END}},
                                              {{'w': CASE WHEN target_mean_ratio > 0 THEN 0.7 ELSE 1.2 END, 'x': CASE WHEN forward_eps > 0 THEN least(greatest(forward_eps * CASE WHEN multiple IS NULL THEN due ELSE (due + multiple) / 2 END, 0.7 * price), 1.8 * price) END}}], lambda v: v.x IS NOT NULL) AS v FROM fair)
        SELECT ticker, round(list_sum(list_transform(v, lambda p: p.w * p.x)) / list_sum(list_transform(v, lambda p: p.w)), 5) AS long_target FROM views""",
}
