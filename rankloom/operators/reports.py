"""Report payloads and the assistant's queries over a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.operators.factors import FACTORS, FORMULAS, PENALTY_FLAGS
from rankloom.operators.research import DELTAS, IC, SNAPSHOTS, STEP, TRADING_DAYS
from rankloom.operators.research import CUTS as RESEARCH_CUTS
from rankloom.operators.scoring import DEFAULT, RUN
from rankloom.operators.targets import CUTS, RISK, WATCHED
from rankloom.plans.numbering import numbering
from rankloom.plans.rel import Rel, Registry, kept
from rankloom.sources.adapters import SECURITIES

_R = RUN
_RANKING, _CONTRIBUTIONS, _CATEGORIES = _R["ranking"], _R["contributions"], _R["category_scores"]
REG = Registry((*CUTS, *(c for c in RESEARCH_CUTS if c not in CUTS)))

REG.rel("rp_top", "SELECT ticker, rank, round(total_score, 5) AS total_score, pinned FROM ranking WHERE rank <= 15 OR pinned", _RANKING)
REG.rel("rp_percentile", "SELECT ticker, rank, round(100e0 * rank / (SELECT count(*) FROM ranking), 6) AS rank_percentile FROM ranking", _RANKING)
#: Categories as the reports show them, rescaled so that a security's parts add up to its total.
MERGED = Rel(
    "merged_categories",
    """
    SELECT c.ticker, c.shown, c.part * r.total_score / nullif(sum(c.part) OVER (PARTITION BY c.ticker), 0) AS points
    FROM (SELECT ticker, CASE category WHEN 'growth' THEN 'emergence' WHEN 'sentiment' THEN 'risk' WHEN 'preference' THEN 'risk' WHEN 'model' THEN 'potential' ELSE category END AS shown, sum(contribution) AS part
          FROM contributions WHERE contribution IS NOT NULL GROUP BY 1, 2) c JOIN ranking r ON r.ticker = c.ticker""",
    (_CONTRIBUTIONS, _RANKING),
)
REG.rel("rp_categories", "SELECT ticker, shown, round(points, 5) AS points FROM merged_categories", MERGED)
REG.rel("rp_tiles", "SELECT round(max(r.total_score), 5) AS best, count(*) AS n, sum(CASE WHEN d.is_new THEN 1 ELSE 0 END) AS n_new, sum(CASE WHEN r.pinned THEN 1 ELSE 0 END) AS n_pinned, sum(CASE WHEN r.low_confidence THEN 1 ELSE 0 END) AS n_low, (SELECT count(*) FROM active_factors) AS n_active FROM ranking r LEFT JOIN (SELECT ticker, is_new FROM deltas) d ON d.ticker = r.ticker", _RANKING, DELTAS, _R["active_factors"])


def sorted_by(column: str, descending: bool = False, digits: int = 5) -> Rel:
    """The ranking's rows numbered by any of its columns, in either direction; nulls come last, and the ticker settles ties."""
    return numbering("sorted_ranking", _RANKING, "place", (f"round({column}, {digits})", "DESC" if descending else "ASC"), ("ticker", "ASC"))


REG.rel("rp_sorted", "SELECT ticker, round(penalty, 5) AS penalty, place FROM sorted_ranking", sorted_by("penalty"))
REG.rel("rp_sorted_coverage", "SELECT ticker, round(coverage, 5) AS coverage, place FROM sorted_ranking", sorted_by("coverage", descending=True))
#: Tiles of the watch page: positions, mean gain of those with an entry price, and counts by level of risk.
REG.rel("rp_watch_tiles", "SELECT count(*) AS n, round(avg(CASE WHEN w.entry_price IS NOT NULL THEN 100 * (w.price / nullif(w.entry_price, 0) - 1) END), 5) AS mean_pnl, sum(CASE WHEN r.risk_index >= 3 THEN 1 ELSE 0 END) AS n_risky, " + ", ".join(f"sum(CASE WHEN r.risk = '{x}' THEN 1 ELSE 0 END) AS n_{x.lower()}" for x in ("SELL", "HIGH_RISK", "CAUTION", "WATCH", "SAFE")) + " FROM watched w JOIN risk r ON r.ticker = w.ticker", WATCHED, RISK)
#: Days and snapshots that a validated ranking needs.
NEEDED_DAYS, NEEDED_SNAPSHOTS = 120, 60
#: Whether the weights were ever held against forward returns: the snapshots' number and span in days, whether information coefficients exist, progress in percent.
VALIDATION = Rel(
    "validation",
    lambda q: f"""SELECT snapshots, span_days, ic_measured, ic_measured AND span_days >= {NEEDED_DAYS} AND snapshots >= {NEEDED_SNAPSHOTS} AS validated, {NEEDED_DAYS} AS needed_days, {NEEDED_SNAPSHOTS} AS needed_snapshots,
               round(100 * least(1e0, span_days / {NEEDED_DAYS}e0, snapshots / {NEEDED_SNAPSHOTS}e0), 1) AS progress_pct
        FROM (SELECT count(*) AS snapshots, coalesce({q.days("max(t.date)", "min(t.date)")}, 0) AS span_days, (SELECT count(ic_mean) FROM ic) > 0 AS ic_measured
              FROM (SELECT snapshot FROM snapshots GROUP BY snapshot) s JOIN trading_days t ON t.g = s.snapshot * {STEP}) x""",
    (SNAPSHOTS, TRADING_DAYS, IC),
)
REG.rel("rp_validation", "SELECT * FROM validation", VALIDATION)
_ORDERED = Rel("ordered_factors", "SELECT ticker, factor_id, score, contribution, row_number() OVER (PARTITION BY ticker ORDER BY round(contribution, 9) DESC, factor_id) AS best, row_number() OVER (PARTITION BY ticker ORDER BY round(score, 9), factor_id) AS worst FROM contributions WHERE score IS NOT NULL", (_CONTRIBUTIONS,))
REG.rel("as_describe", "SELECT ticker, factor_id, round(score, 5) AS score, best <= 4 AS strongest, worst <= 3 AS weakest FROM ordered_factors WHERE best <= 4 OR worst <= 3", _ORDERED)
REG.rel("as_factor_top", "SELECT factor_id, ticker, round(score, 5) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY round(score, 9) DESC, ticker) AS place FROM contributions WHERE score IS NOT NULL) x WHERE place <= 5", _CONTRIBUTIONS)
def compare(left: str, right: str) -> Rel:
    """The category scores of any two securities side by side; a category that one of them lacks has null there."""
    score = lambda t: f"max(CASE WHEN ticker = {text_literal(t)} THEN category_score END)"
    return Rel("compared", f"SELECT category, {score(left)} AS left_score, {score(right)} AS right_score FROM category_scores WHERE ticker IN ({text_literal(left)}, {text_literal(right)}) GROUP BY category", (_CATEGORIES,))


def text_literal(x: str) -> str:
    """A text as an SQL literal of both engines."""
    if "\\" in x:
        raise ValueError("no symbol holds a backslash")
    return "'" + x.replace("'", "''") + "'"


REG.rel("as_compare", "SELECT category, round(left_score, 5) AS left_score, round(right_score, 5) AS right_score FROM compared", compare("T000001", "T000002"))
REG.rel("as_sector", "SELECT sector, ticker, rank FROM (SELECT sector, ticker, rank, row_number() OVER (PARTITION BY sector ORDER BY rank) AS place FROM ranking) x WHERE place <= 5", _RANKING)
REG.rel("as_price_below", "SELECT ticker, rank, price FROM (SELECT r.ticker, r.rank, round(f.price, 8) AS price, row_number() OVER (ORDER BY r.rank) AS place FROM ranking r JOIN (SELECT ticker, price FROM factors) f ON f.ticker = r.ticker WHERE f.price < 1500) x WHERE place <= 12", _RANKING, FACTORS)
REG.rel("as_bottom", "SELECT ticker, rank FROM ranking WHERE rank > (SELECT count(*) FROM ranking) - 5", _RANKING)
#: Words that lead a question to a factor.
TOPICS = {"momentum": "price_momentum_12_1", "trend": "trend_structure", "value": "valuation_composite", "quality": "quality_profitability", "growth": "growth_quality", "analyst": "analyst_upside", "risk": "risk_drawdown", "volume": "volume_accumulation", "liquid": "liquidity", "short": "short_squeeze", "cash": "cash_runway", "size": "size_opportunity", "breakout": "breakout_setup", "stage": "stage2_breakout", "attention": "reddit_wsb_attention"}


def topics_of(questions: Rel) -> Rel:
    """Factors that a question (column ``question``) is about: one for each topic word in it."""
    return Rel("topics", lambda q: f"SELECT x.question, t.factor_id FROM {questions.name} x JOIN {q.values(('word', 'factor_id'), [(f"'{w}'", f"'{f}'") for w, f in TOPICS.items()])} t ON x.question LIKE concat('%', t.word, '%')", (questions,))


#: A question about each security, of two topics or none.
_ASKED = Rel("asked", "SELECT concat('which have good ', " + ", ' and ', ".join("CASE k % {} ".format(len(TOPICS) + n) + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(TOPICS)) + " ELSE 'names' END" for n in (1, 3)) + ", ' like ', lower(name)) AS question FROM securities", (SECURITIES,))
REG.rel("as_topics", "SELECT question, factor_id FROM topics", topics_of(_ASKED))


#: One wide row per ranked security: identity, scores, returns, and each factor's score and raw value.
FLAT = Rel(
    "flat_ranking",
    "SELECT r.rank, r.ticker, f.name, r.sector, f.price, f.market_cap, r.total_score, r.base, r.penalty, r.coverage, f.return_1m, f.return_3m, f.return_6m, f.return_12m, "
    + ", ".join(f"w.score__{f.id}, f.{f.id} AS raw__{f.id}" for f in DEFAULT.factors if f.id in FORMULAS)
    + " FROM ranking r JOIN factors f ON f.ticker = r.ticker JOIN (SELECT ticker, " + ", ".join(f"max(CASE WHEN factor_id = '{f.id}' THEN score END) AS score__{f.id}" for f in DEFAULT.factors if f.id in FORMULAS)
    + " FROM weighted GROUP BY ticker) w ON w.ticker = r.ticker",
    (_RANKING, _R["weighted"], FACTORS),
)
REG.rel("snk_flat_ranking", "SELECT rank, ticker, name, sector, round(price, 8) AS price, round(total_score, 5) AS total_score, round(return_3m, 6) AS return_3m, " + ", ".join(f"round(score__{f.id}, 5) AS score__{f.id}, round(raw__{f.id}, 6) AS raw__{f.id}" for f in DEFAULT.factors if f.id in FORMULAS) + " FROM flat_ranking", FLAT)
_SCORED = Rel("scored_factors", "SELECT a.factor_id, a.category, a.w, a.coverage, c.ticker, c.score, row_number() OVER (PARTITION BY a.factor_id ORDER BY round(c.score, 9) DESC, c.ticker) AS place FROM active_factors a JOIN contributions c ON c.factor_id = a.factor_id WHERE c.score IS NOT NULL", (_R["active_factors"], _CONTRIBUTIONS))
REG.rel("as_explain_factor", "SELECT factor_id, category, round(w, 4) AS weight, round(coverage, 4) AS coverage, ticker, round(score, 5) AS score, place FROM scored_factors WHERE place <= 3", _SCORED)


def find(pattern: str) -> Rel:
    """Ranked securities whose ticker or name holds a text, whatever its case; exact tickers first."""
    text = pattern.upper().replace("'", "''")
    return Rel("found", f"SELECT r.ticker, f.name, r.rank, upper(r.ticker) = '{text}' AS exact FROM ranking r JOIN factors f ON f.ticker = r.ticker WHERE upper(r.ticker) LIKE '%{text}%' OR upper(f.name) LIKE '%{text}%'", (_RANKING, FACTORS))


def by_price(low: float | None = None, high: float | None = None, top: int = 12) -> Rel:
    """The best-ranked securities with a price above and below two bounds."""
    tests = [f"f.price > {low}"] * (low is not None) + [f"f.price < {high}"] * (high is not None)
    return Rel("by_price", f"SELECT * FROM (SELECT r.ticker, r.rank, f.price, row_number() OVER (ORDER BY r.rank) AS place FROM ranking r JOIN factors f ON f.ticker = r.ticker{' WHERE ' * bool(tests)}{' AND '.join(tests)}) x WHERE place <= {top}", (_RANKING, FACTORS))


REG.rel("as_find", "SELECT ticker, name, rank, exact FROM found", find("00001"))
REG.rel("as_price_above", "SELECT ticker, rank, round(price, 8) AS price FROM by_price", by_price(low=1400))
REG.rel("as_overall_top", "SELECT ticker, rank, round(price, 8) AS price FROM by_price", by_price(top=10))
REG.rel("as_scan_summary", "SELECT count(*) AS ranked, (SELECT count(*) FROM securities) AS universe, round(avg(total_score), 5) AS mean_score, round(avg(coverage), 6) AS mean_coverage, sum(CASE WHEN low_confidence THEN 1 ELSE 0 END) AS n_low, sum(CASE WHEN penalty < 0 THEN 1 ELSE 0 END) AS n_penalised FROM ranking", _RANKING, SECURITIES)
REG.rel("rp_search", "SELECT r.ticker, f.name, r.sector, r.rank FROM ranking r JOIN factors f ON f.ticker = r.ticker WHERE r.sector = 'ASIA' AND (r.ticker LIKE '%1%' OR upper(f.name) LIKE '%1%')", _RANKING, FACTORS)


def export_json(spark: SparkSession, ranking: DataFrame, contributions: DataFrame, categories: DataFrame, factors: DataFrame, flags: DataFrame, top: int = 30) -> DataFrame:
    """One JSON document per ranked security: identity, scores, trailing returns, category scores, strengths (score from 70 on, five of the largest contribution), weaknesses (30 or less, five of the smallest contribution) and penalties."""
    return spark.sql(
        """SELECT r.rank, to_json(struct(r.rank, r.ticker, f.name, r.sector, round(f.price, 4) AS price, round(r.total_score, 2) AS total_score, round(r.coverage, 3) AS coverage, r.low_confidence,
             g.category_scores, named_struct('1m', round(f.return_1m, 4), '3m', round(f.return_3m, 4), '6m', round(f.return_6m, 4), '12m', round(f.return_12m, 4)) AS trailing_returns,
             slice(array_sort(filter(c.f, x -> x.score >= 70), (a, b) -> cast(sign(b.contribution - a.contribution) AS int)), 1, 5) AS strengths,
             slice(array_sort(filter(c.f, x -> x.score <= 30), (a, b) -> cast(sign(a.contribution - b.contribution) AS int)), 1, 5) AS weaknesses, coalesce(p.penalties, array()) AS penalties)) AS document
           FROM {ranking} r JOIN {factors} f ON f.ticker = r.ticker
           JOIN (SELECT ticker, array_sort(collect_list(struct(factor_id AS factor, round(score, 2) AS score, round(w, 2) AS weight, round(contribution, 3) AS contribution))) AS f FROM {contributions} WHERE score IS NOT NULL GROUP BY ticker) c ON c.ticker = r.ticker
           LEFT JOIN (SELECT ticker, map_from_entries(array_sort(collect_list(struct(category, round(category_score, 1))))) AS category_scores FROM {categories} GROUP BY ticker) g ON g.ticker = r.ticker
           LEFT JOIN (SELECT ticker, array_sort(collect_list(penalty_id)) AS penalties FROM {flags} GROUP BY ticker) p ON p.ticker = r.ticker
           WHERE r.rank <= {top}""",
        ranking=ranking, contributions=contributions, categories=categories, factors=factors, flags=flags, top=top,
    )


def methodology_json(spark: SparkSession, active: DataFrame, stats: DataFrame, universe: DataFrame, least: float = DEFAULT.min_coverage) -> DataFrame:
    """One JSON document on how scores come about: active factors with weights and coverage, disabled ones, size of the universe."""
    return spark.sql(
        """SELECT to_json(struct('Weighted cross-sectional factors, each normalised to 0-100; the weight of missing factors goes to the others and the score shrinks to 50 with coverage.' AS description, array(0, 100) AS score_range,
             (SELECT array_sort(collect_list(struct(factor_id AS id, category, round(w, 2) AS weight, round(coverage, 4) AS coverage))) FROM {active}) AS factors,
             (SELECT array_sort(collect_list(struct(factor_id AS id, round(coverage, 4) AS coverage))) FROM {stats} WHERE coverage < {least}) AS auto_disabled_factors,
             (SELECT n_universe FROM {universe}) AS universe_size)) AS document""",
        active=active, stats=stats, universe=universe, least=least,
    )


@REG.function
def snk_llm_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents of the thirty best."""
    factors = kept(FACTORS, spark, sf_dir, CUTS)
    cut = {"factors": factors}
    return export_json(spark, _RANKING.on(spark, **cut), _CONTRIBUTIONS.on(spark, **cut), _CATEGORIES.on(spark, **cut), factors, PENALTY_FLAGS.on(spark, **cut))


@REG.function
def snk_methodology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export's head."""
    cut = {"factors": kept(FACTORS, spark, sf_dir, CUTS)}
    return methodology_json(spark, *(_R[n].on(spark, **cut) for n in ("active_factors", "factor_stats", "universe_count")))


@REG.function
def snk_dashboard_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's payload: one JSON text with the number of all scored securities and the hundred best (a top list, so one row stays small)."""
    rows = _RANKING.on(spark, factors=kept(FACTORS, spark, sf_dir, CUTS))
    return spark.sql(
        """SELECT to_json(struct((SELECT count(*) FROM {r}) AS totalScored, (SELECT round(max(total_score), 2) FROM {r}) AS best, (SELECT sum(CASE WHEN low_confidence THEN 1 ELSE 0 END) FROM {r}) AS lowConfidence,
             array_sort(collect_list(struct(rank, ticker, sector, round(total_score, 2) AS score))) AS rows)) AS payload FROM {r} WHERE rank <= 100""",
        r=rows,
    )
