"""Scoring: normalise factors across the universe, weight, redistribute, shrink, penalise and rank.

``scorer`` builds the relations for a configuration. They read ``factor_values`` (ticker, sector, factor_id,
raw) and ``penalty_flags`` (ticker, penalty_id). The universe is every ticker among the values; a row that is
absent counts like one whose raw is null. Coverage and weights are one small relation of a row per factor,
broadcast to a window by factor and an aggregate by ticker, whatever the number of factors. Values of a factor tie
where they are equal in single precision, total scores where they are equal to SCORE_DIGITS digits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from rankloom.functions.expr import bands, clamp, d, level
from rankloom.operators.factors import CUTS, FACTOR_VALUES, PENALTY_FLAGS
from rankloom.plans.numbering import numbering
from rankloom.plans.rel import Rel, Registry

REG = Registry()


@dataclass(frozen=True)
class Factor:
    """norm: rank (percentile), raw (0 to 100 as it is) or band; bands: (bound, score, label)."""

    id: str
    category: str
    weight: float = 1.0
    norm: str = "rank"
    lower_better: bool = False
    bands: tuple[tuple[float, float, str], ...] = ()


@dataclass(frozen=True)
class Config:
    factors: tuple[Factor, ...]
    #: id -> (sigma, points); points count where sigma is None.
    penalties: dict[str, tuple[float | None, float]] = field(default_factory=dict)
    #: (id, budget, members); the members' weights are scaled to the budget, up or down.
    clusters: tuple[tuple[str, float, tuple[str, ...]], ...] = ()
    min_coverage: float = 0.15
    min_confidence: float = 0.60
    min_include: float = 0.55
    shrink_power: float = 1.0
    penalty_cap: float = 2.2
    neutralize: bool = True
    overrides: dict[str, float] = field(default_factory=dict)
    pinned: tuple[str, ...] = ()


#: Bands of the analysts' mean rating and of the share price.
RATING = ((1.5, 100, "Strong Buy"), (2.0, 82, "Buy"), (2.5, 62, "Weak Buy"), (3.0, 38, "Hold"), (3.5, 18, "Hold / Sell"), (5.1, 0, "Sell"))
PRICE = ((1, 10, "Penny"), (5, 55, "Very low"), (50, 100, "Ideal"), (150, 85, "Middle"), (400, 65, "High"), (1e12, 45, "Very high"))

#: Category of each factor.
CATEGORIES = {
    "eps_revision_momentum": "analyst", "trend_structure": "technical", "valuation_composite": "valuation", "price_momentum_12_1": "momentum", "quality_profitability": "quality",
    "technical_oscillators": "technical", "financial_health": "quality", "breakout_setup": "technical", "growth_quality": "growth", "analyst_upside": "potential", "relative_strength": "momentum",
    "momentum_persistence": "technical", "chart_position": "potential", "volume_accumulation": "technical", "revenue_scaling": "emergence", "size_opportunity": "emergence",
    "stage2_breakout": "technical", "rule_of_40": "emergence", "undiscovered": "emergence", "cash_runway": "quality", "model_score": "model", "earnings_surprise": "analyst",
    "analyst_consensus": "analyst", "risk_drawdown": "risk", "liquidity": "risk", "reddit_wsb_attention": "sentiment", "short_squeeze": "sentiment", "nominal_price_fit": "preference",
}
#: Tasks over which the sort of one factor's values spreads.
RANGES = 32
#: Digits of a total score by which securities are ranked, those that are shown; the ticker settles ties. Later digits are the order of sums.
SCORE_DIGITS = 5
_RAW = ("trend_structure", "technical_oscillators", "financial_health", "reddit_wsb_attention")

DEFAULT = Config(
    tuple(Factor(f, c, 1.0 + (i % 5) * 0.5, "raw" if f in _RAW else "band" if f == "nominal_price_fit" else "rank", f == "analyst_consensus", RATING if f == "analyst_consensus" else PRICE if f == "nominal_price_fit" else ()) for i, (f, c) in enumerate(CATEGORIES.items())),
    {p: (-0.25, 0.0) for p in ("negative_fcf_high_debt", "hype_reversal_risk", "parabolic_extension", "distribution_pattern", "earnings_imminent")},
    (("trend", 10.0, ("trend_structure", "price_momentum_12_1", "relative_strength", "momentum_persistence", "stage2_breakout")),),
)


def _text(x: str | None) -> str:
    return "cast(NULL AS varchar(64))" if x is None else "'" + x.replace("'", "''") + "'"


def scorer(cfg: Config, values: Rel = FACTOR_VALUES, flags: Rel = PENALTY_FLAGS) -> dict[str, Rel]:
    """Relations of a scoring run: normalised, weighted, base, scores (the ranking's rows), ranking, contributions, category_scores."""
    ids = [f.id for f in cfg.factors]
    cluster = {m: (c, b) for c, b, members in cfg.clusters for m in members if m in ids}
    rows = [(_text(f.id), _text(f.category), _text(f.norm), str(f.lower_better).upper(), d(cfg.overrides.get(f.id, f.weight)), _text(cluster.get(f.id, (None, 0))[0]), d(cluster.get(f.id, (None, 0))[1])) for f in cfg.factors]
    names = ("factor_id", "category", "norm", "lower_better", "weight", "cluster", "budget")
    banded = [f for f in cfg.factors if f.bands]
    score_of = "CASE " + " ".join(f"WHEN f.factor_id = '{f.id}' THEN {bands('raw', [(b, d(s)) for b, s, _ in f.bands], d(f.bands[-1][1]))}" for f in banded) + " ELSE cast(NULL AS double) END"
    label_of = "CASE " + " ".join(f"WHEN f.factor_id = '{f.id}' THEN {bands('raw', [(b, _text(t)) for b, _, t in f.bands], _text(f.bands[-1][2]))}" for f in banded) + " ELSE cast(NULL AS varchar(64)) END"
    if not banded:
        score_of, label_of = "cast(NULL AS double)", "cast(NULL AS varchar(64))"
    config = Rel("factor_config", lambda q: f"SELECT * FROM {q.values(names, rows)} f")
    universe = Rel("universe_count", f"SELECT count(DISTINCT ticker) AS n_universe FROM {values.name}", (values,))
    #: Configured factors with the share of the universe that has a value.
    stats = Rel(
        "factor_stats",
        f"""SELECT f.*, v.n_values, v.n_values / cast((SELECT n_universe FROM universe_count) AS double) AS coverage
        FROM factor_config f JOIN (SELECT factor_id, count(raw) AS n_values FROM {values.name} GROUP BY factor_id) v ON v.factor_id = f.factor_id""",
        (config, universe, values),
        cut=True,
    )
    #: Factors that are covered well enough, with their weights scaled to their cluster's budget.
    scaled = Rel(
        "factor_scaled",
        f"""
        SELECT *, CASE WHEN cluster IS NOT NULL AND n_cluster >= 2 AND in_cluster > 0 AND budget > 0 THEN weight * budget / in_cluster ELSE weight END AS scaled
        FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS n_cluster, sum(weight) OVER (PARTITION BY cluster) AS in_cluster FROM factor_stats WHERE coverage >= {d(cfg.min_coverage)}) x""",
        (stats,),
    )
    #: Their weights scaled to 100; none where they sum to zero.
    active = Rel("active_factors", "SELECT *, 100 * scaled / (SELECT sum(scaled) FROM factor_scaled) AS w FROM factor_scaled WHERE (SELECT sum(scaled) FROM factor_scaled) > 0", (scaled,))
    def placed(q) -> str:
        """Values with their rank within the factor. On Spark they are dealt by factor and range of values (absent ones by ticker), ranked within a range and raised by what lower ranges hold, so that a factor's sort spreads over RANGES tasks."""
        if q.name != "spark":
            return f"SELECT ticker, sector, factor_id, raw, rank() OVER (PARTITION BY factor_id ORDER BY {level('raw')} NULLS LAST) AS low_rank, count(*) OVER (PARTITION BY factor_id, {level('raw')}) AS n_equal FROM {values.name}"
        return f"""
            WITH factor_edges AS (SELECT factor_id, percentile_approx({level('raw')}, array({', '.join(d(k / RANGES) for k in range(1, RANGES))}), 1000) AS edges FROM {values.name} WHERE raw IS NOT NULL GROUP BY factor_id),
            ranged AS (SELECT v.ticker, v.sector, v.factor_id, v.raw, CASE WHEN v.raw IS NULL THEN -1 - pmod(hash(v.ticker), {RANGES}) ELSE size(filter(e.edges, x -> x < {level('v.raw')})) END AS part FROM {values.name} v LEFT JOIN factor_edges e ON e.factor_id = v.factor_id),
            lower_ranges AS (SELECT factor_id, part, sum(n) OVER (PARTITION BY factor_id ORDER BY part) - n AS n_lower FROM (SELECT factor_id, part, count(*) AS n FROM ranged WHERE raw IS NOT NULL GROUP BY factor_id, part) x)
            SELECT r.ticker, r.sector, r.factor_id, r.raw, r.low_rank + coalesce(p.n_lower, 0) AS low_rank, r.n_equal
            FROM (SELECT *, rank() OVER (PARTITION BY factor_id, part ORDER BY {level('raw')}) AS low_rank, count(*) OVER (PARTITION BY factor_id, part, {level('raw')}) AS n_equal FROM ranged) r
            LEFT JOIN lower_ranges p ON p.factor_id = r.factor_id AND p.part = r.part"""

    ranked = Rel(
        "ranked",
        lambda q: f"""
        SELECT v.ticker, v.sector, f.factor_id, f.category, f.norm, f.lower_better, f.weight, f.cluster, f.budget, v.raw, f.coverage,
               CASE WHEN v.raw IS NULL THEN NULL WHEN f.n_values = 1 THEN 50e0 ELSE 100 * (v.low_rank + (v.n_equal - 1) / 2e0) / f.n_values END AS percentile,
               {score_of} AS band_score, {label_of} AS band_label
        FROM ({placed(q)}) v
        JOIN factor_stats f ON f.factor_id = v.factor_id""",
        (values, stats),
    )
    neutral = f"norm = 'rank' AND category <> 'preference' AND {str(cfg.neutralize).upper()}"
    normalised = Rel(
        "normalised",
        f"""
        SELECT *, CASE WHEN {neutral} AND n_sector >= 5 AND sd_sector >= 1e-9 THEN {clamp(0, 100, '50 + 15 * (directed - mean_sector) / sd_sector')} ELSE directed END AS score
        FROM (SELECT *, count(directed) OVER (PARTITION BY factor_id, sector) AS n_sector, avg(directed) OVER (PARTITION BY factor_id, sector) AS mean_sector, stddev_pop(directed) OVER (PARTITION BY factor_id, sector) AS sd_sector
              FROM (SELECT *, CASE norm WHEN 'band' THEN band_score WHEN 'raw' THEN CASE WHEN raw IS NOT NULL THEN greatest(0e0, least(100e0, raw)) END
                                 ELSE CASE WHEN lower_better THEN 100 - percentile ELSE percentile END END AS directed
                    FROM ranked WHERE coverage >= {d(cfg.min_coverage)}) x) y""",
        (ranked,),
    )
    weighted = Rel("weighted", "SELECT x.*, a.w FROM normalised x JOIN active_factors a ON a.factor_id = x.factor_id", (normalised, active))
    raw_base = "sum(CASE WHEN score IS NOT NULL THEN score * w END) / nullif(sum(CASE WHEN score IS NOT NULL THEN w END), 0)"
    coverage = "least(1e0, coalesce(sum(CASE WHEN score IS NOT NULL THEN w END), 0e0) / 100)"
    base = Rel(
        "base",
        f"SELECT ticker, max(sector) AS sector, {raw_base} AS base_raw, {coverage} AS coverage, "
        + (f"50 + ({raw_base} - 50) * power({coverage}, {d(cfg.shrink_power)})" if cfg.shrink_power > 0 else raw_base)
        + f" AS base FROM (SELECT ticker, sector, score, w FROM weighted UNION ALL SELECT ticker, sector, cast(NULL AS double), cast(NULL AS double) FROM {values.name} WHERE (SELECT count(*) FROM active_factors) > 0) x GROUP BY ticker",
        (values, weighted, active),
        cut=True,
    )
    spread = Rel("base_spread", "SELECT CASE WHEN coalesce(stddev_pop(base), 0e0) < 1e-6 THEN 1e0 ELSE stddev_pop(base) END AS sigma FROM base", (base,))
    penalty_rows = [(_text(p), "cast(NULL AS double)" if s is None else d(s), d(pt)) for p, (s, pt) in cfg.penalties.items()] or [("'-'", "0e0", "0e0")]
    pins = ", ".join(_text(t) for t in cfg.pinned) or "'-'"
    scores = Rel(
        "scores",
        lambda q: f"""
        SELECT *, {clamp(0, 100, 'base + penalty')} AS total_score, coverage < {d(cfg.min_confidence)} AS low_confidence
        FROM (SELECT b.*, b.ticker IN ({pins}) AS pinned, coalesce(h.n_penalties, 0) AS n_penalties, greatest({d(-abs(cfg.penalty_cap))}, coalesce(h.sigmas, 0e0) + coalesce(h.points, 0e0) / b.sigma) * b.sigma AS penalty
              FROM (SELECT *, (SELECT sigma FROM base_spread) AS sigma FROM base) b
              LEFT JOIN (SELECT g.ticker, count(*) AS n_penalties, sum(coalesce(p.sigma, 0e0)) AS sigmas, sum(CASE WHEN p.sigma IS NULL THEN p.points ELSE 0e0 END) AS points
                         FROM {flags.name} g JOIN {q.values(("penalty_id", "sigma", "points"), penalty_rows)} p ON p.penalty_id = g.penalty_id GROUP BY g.ticker) h ON h.ticker = b.ticker) x""",
        (base, spread, flags),
    )
    rankable = Rel("rankable", f"SELECT * FROM scores WHERE coverage >= {d(cfg.min_include)} OR pinned", (scores,))
    ranking = numbering("ranking", rankable, "rank", (f"round(total_score, {SCORE_DIGITS})", "DESC"), ("ticker", "ASC"))
    contributions = Rel("contributions", "SELECT ticker, factor_id, category, score, w, score * w / 100 AS contribution, band_label FROM weighted", (weighted,))
    category_scores = Rel("category_scores", "SELECT ticker, category, sum(score * w) / nullif(sum(w), 0) AS category_score FROM weighted WHERE score IS NOT NULL GROUP BY ticker, category", (weighted,))
    return {r.name: r for r in (universe, stats, active, ranked, normalised, weighted, base, scores, ranking, contributions, category_scores)}


def score(values: DataFrame, flags: DataFrame, cfg: Config = DEFAULT, want: str = "ranking") -> DataFrame:
    """A scoring run over frames of factor values and penalty flags. An empty universe, or one without active factors, gives an empty result."""
    return scorer(cfg)[want].on(values.sparkSession, factor_values=values, penalty_flags=flags)


#: The default scoring run's relations; what others build on is kept for a session.
RUN = _R = scorer(DEFAULT)
CUTS = REG.cuts = (*CUTS, _R["factor_stats"], _R["normalised"], _R["base"], _R["ranking"])
REG.rel("sc_percentile", "SELECT ticker, factor_id, round(coverage, 6) AS coverage, round(percentile, 6) AS percentile FROM ranked", _R["ranked"])
REG.rel("sc_coverage", "SELECT factor_id, round(coverage, 6) AS coverage, coverage < 0.15 AS auto_disabled FROM factor_stats", _R["factor_stats"])
REG.rel("sc_bands", "SELECT ticker, factor_id, band_score, band_label FROM ranked WHERE band_label IS NOT NULL", _R["ranked"])
REG.rel("sc_normalised", "SELECT ticker, factor_id, round(directed, 6) AS directed, round(score, 5) AS score FROM normalised", _R["normalised"])
REG.rel("sc_weights", "SELECT factor_id, category, cluster, round(weight, 6) AS weight, round(w, 6) AS w, round(coverage, 4) AS coverage FROM active_factors", _R["active_factors"])
REG.rel("sc_clusters", "SELECT cluster, count(*) AS members, round(max(in_cluster), 2) AS weight_before, round(max(budget), 2) AS weight_after, round(max(budget) / max(in_cluster), 3) AS scale FROM active_factors WHERE cluster IS NOT NULL AND n_cluster >= 2 AND in_cluster > 0 AND budget > 0 GROUP BY cluster", _R["active_factors"])
REG.rel("sc_base", "SELECT ticker, round(base_raw, 5) AS base_raw, round(coverage, 6) AS coverage, round(base, 5) AS base FROM base", _R["base"])
REG.rel("sc_penalties", "SELECT ticker, n_penalties, round(sigma, 5) AS sigma, round(penalty, 5) AS penalty FROM scores", _R["scores"])
REG.rel("sc_ranking", "SELECT ticker, sector, round(base, 5) AS base, round(penalty, 5) AS penalty, round(total_score, 5) AS total_score, round(coverage, 6) AS coverage, low_confidence, rank FROM ranking", _R["ranking"])
REG.rel("sc_excluded", "SELECT ticker, round(coverage, 6) AS coverage FROM scores WHERE coverage < 0.55 AND NOT pinned", _R["scores"])
REG.rel("sc_contributions", "SELECT ticker, factor_id, round(contribution, 5) AS contribution FROM contributions", _R["contributions"])
REG.rel("sc_categories", "SELECT ticker, category, round(category_score, 5) AS category_score FROM category_scores", _R["category_scores"])
REG.rel("sc_diagnostics", "SELECT count(*) AS universe_size, round(avg(coverage), 6) AS mean_coverage, round(max(sigma), 5) AS penalty_sigma, sum(CASE WHEN coverage < 0.55 THEN 1 ELSE 0 END) AS n_excluded, sum(CASE WHEN low_confidence THEN 1 ELSE 0 END) AS n_low_confidence, sum(n_penalties) AS n_penalties FROM scores", _R["scores"])

#: The same values with two thirds of the rows left out by a rule, as a sparse source would have them; the result equals that of null rows.
_SPARSE = Rel("sparse_values", "SELECT ticker, sector, factor_id, raw FROM factor_values WHERE (length(factor_id) + cast(substr(ticker, 2) AS int)) % 3 = 0 OR factor_id LIKE '%m%'", (FACTOR_VALUES,))
_S = scorer(DEFAULT, _SPARSE)
REG.rel("sc_sparse_ranking", "SELECT ticker, round(base, 5) AS base, round(penalty, 5) AS penalty, round(total_score, 5) AS total_score, round(coverage, 6) AS coverage, rank FROM ranking", _S["ranking"])
REG.rel("sc_sparse_excluded", "SELECT ticker, round(coverage, 6) AS coverage FROM scores WHERE coverage < 0.55 AND NOT pinned", _S["scores"])
