"""Feature snapshots, forward-return labels, information coefficients, learned weights and leak-free folds.

Snapshots are taken on every 21st trading day, as of each security's last bar then. The as-of join is an
equality join: trading days are numbered, and each bar spans the numbers up to the next bar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.quantiles import exact_quantiles
from rankloom.operators.factors import FACTORS, FORMULAS, PENALTIES
from rankloom.operators.histories import marked
from rankloom.operators.indicators import CLOSED, INDICATORS
from rankloom.operators.scoring import CUTS, DEFAULT, RUN
from rankloom.plans.rel import Rel, Registry
from rankloom.sources.adapters import BARS

REG = Registry()
STEP, HORIZON, EMBARGO, SPLITS = 21, 21, 5, 4
FEATURES = ("rsi14", "pct_b", "adx", "donchian", "roc12", "mom21", "mom63", "vol_ratio")

TRADING_DAYS = Rel("trading_days", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS g FROM (SELECT DISTINCT date FROM bars) x", (BARS,))


def _marked(closed: DataFrame, days: DataFrame) -> DataFrame:
    return marked(closed.join(F.broadcast(days), "date", "left"), HORIZON).join(F.broadcast(days.agg(F.max("g").alias("g_last"))))


#: Each bar's features, its day's number and that of the ticker's next bar; on Spark tasks make them as they make the profile, and the days (a row each) are broadcast.
MARKED = Rel(
    "marked_bars",
    lambda q: f"""SELECT {q.small("t")}i.ticker, i.date, i.close, t.g, lead(t.g) OVER (PARTITION BY i.ticker ORDER BY i.date) AS g_next, (SELECT max(g) FROM trading_days) AS g_last,
               lead(i.close, {HORIZON}) OVER (PARTITION BY i.ticker ORDER BY i.date) / nullif(i.close, 0) - 1 AS forward,
               i.rsi14, i.pct_b, i.adx, i.donchian, i.roc12, i.close / nullif(lag(i.close, 21) OVER (PARTITION BY i.ticker ORDER BY i.date), 0) - 1 AS mom21,
               i.close / nullif(lag(i.close, 63) OVER (PARTITION BY i.ticker ORDER BY i.date), 0) - 1 AS mom63, i.volume / nullif(avg(i.volume) OVER (PARTITION BY i.ticker ORDER BY i.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS vol_ratio
        FROM indicators i JOIN trading_days t ON t.date = i.date""",
    (INDICATORS, TRADING_DAYS),
    run=_marked,
    reads=(CLOSED, TRADING_DAYS),
)
#: One row per security and snapshot: number, day of the bar, features and the return over the next 21 bars (null while they haven't passed).
SNAPSHOTS = Rel(
    "snapshots",
    lambda q: f"""
    SELECT ticker, s AS snapshot, date AS bar_date, close, forward, {", ".join(FEATURES)}, mom63 AS score
    FROM (SELECT *, {q.explode(q.numbers("s_from", "s_to"))} AS s
          FROM (SELECT *, cast(ceil(g / {STEP}e0) AS bigint) AS s_from, cast(floor((coalesce(g_next - 1, g_last)) / {STEP}e0) AS bigint) AS s_to FROM marked_bars) x WHERE s_from <= s_to) y""",
    (MARKED,),
)


def quantiles(name: str, source: Rel, wanted: dict[str, tuple[str, float]]) -> Rel:
    """One row with the exact quantiles of a relation: name -> (expression, share). Between two values they are interpolated, so the median of an even count is the mean of the middle two."""

    def run(df: DataFrame) -> DataFrame:
        found = exact_quantiles(df, wanted)
        return df.sparkSession.createDataFrame([tuple(found.values())] if found else [(None,)], ", ".join(f"`{n}` double" for n in found) or "n double")

    text = lambda q: "SELECT " + (", ".join(f"{q.quantile(x, repr(p))} AS {n}" for n, (x, p) in wanted.items()) or "count(*) AS n") + f" FROM {source.name}"
    return Rel(name, text, (source,), run=run)


def filled(feature: str) -> str:
    """What a missing feature becomes: the middle score, no flag or penalty, else the column's median."""
    if feature.startswith("score_"):
        return "50e0"
    return "0e0" if feature.startswith(("has_", "penalty_")) else f"(SELECT {feature} FROM panel_medians)"


def study(features: tuple[str, ...], snapshots: Rel = SNAPSHOTS) -> dict[str, Rel]:
    """Relations over any snapshots (ticker, snapshot, forward and the features, factor scores for instance): labelled, ic_days, ic, learned_weights and panel.

    The label is the forward return less the snapshot's mean. An information coefficient is the rank
    correlation (equal values share their mean rank) of a feature with the label in one snapshot. The panel
    has the snapshots of at least 30 labelled securities; missing features are filled (``filled``), then
    ranked to -1..1 within the snapshot (ties by ticker).
    """
    labelled = Rel("labelled", f"SELECT *, forward - avg(forward) OVER (PARTITION BY snapshot) AS excess FROM {snapshots.name}", (snapshots,))
    long = Rel("long_features", lambda q: "SELECT ticker, snapshot, excess, " + q.stack(("feature", "x"), [(f"'{f}'", f"cast({f} AS double)") for f in features]) + " FROM labelled", (labelled,))
    ic_days = Rel(
        "ic_days",
        """
        SELECT feature, snapshot, count(*) AS n, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS ic FROM (
          SELECT feature, snapshot, x, rank() OVER (PARTITION BY feature, snapshot ORDER BY x) + (count(*) OVER (PARTITION BY feature, snapshot, x) - 1) / 2e0 AS rx,
                 rank() OVER (PARTITION BY feature, snapshot ORDER BY excess) + (count(*) OVER (PARTITION BY feature, snapshot, excess) - 1) / 2e0 AS ry
          FROM long_features WHERE x IS NOT NULL AND excess IS NOT NULL) r
        GROUP BY feature, snapshot HAVING count(*) >= 10 AND count(DISTINCT x) > 2""",
        (long,),
    )
    ic = Rel("ic", "SELECT feature, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_sd, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, count(ic) AS periods FROM ic_days GROUP BY feature", (ic_days,))
    learned = Rel(
        "learned_weights",
        "SELECT feature, 100 * w / nullif(sum(w) OVER (), 0) AS weight FROM (SELECT feature, greatest(ic_mean, 0e0) * (greatest(0e0, least(2e0, abs(coalesce(icir, 0e0)))) / 2 + 0.5e0) AS w FROM ic) x",
        (ic,),
    )
    full = Rel("panel_rows", "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY snapshot) AS n FROM labelled WHERE excess IS NOT NULL) x WHERE n >= 30", (labelled,), cut=True)
    measured = [f for f in features if "panel_medians" in filled(f)]
    medians = quantiles("panel_medians", full, {f: (f, 0.5) for f in measured})
    panel = Rel(
        "panel",
        "SELECT ticker, snapshot, excess AS y, "
        + ", ".join(f"CASE WHEN n < 2 THEN 0e0 ELSE 2e0 * (row_number() OVER (PARTITION BY snapshot ORDER BY {f}, ticker) - 1) / greatest(1, n - 1) - 1 END AS x_{f}" for f in features)
        + " FROM (SELECT ticker, snapshot, excess, n, " + ", ".join(f"coalesce({f}, {filled(f)}) AS {f}" for f in features) + " FROM panel_rows) y",
        (full, medians),
    )
    return {r.name: r for r in (labelled, ic_days, ic, learned, panel)}


_STUDY = study(FEATURES)
LABELLED, IC_DAYS, IC, LEARNED, PANEL = _STUDY.values()


def feature_columns(store: DataFrame) -> tuple[str, ...]:
    """Numeric columns of a feature store that hold more than one value, in order of name; ids, labels and the scores that the label would feed back into stay out."""
    apart = {"ticker", "snapshot", "snapshot_date", "sector", "industry", "rank", "total_score", "base_score", "price", "market_cap", "close", "forward", "excess", "bar_date"}
    numeric = [c for c, t in store.dtypes if c not in apart and t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    if not numeric:
        return ()
    varied = store.agg(*[(F.min(c) < F.max(c)).alias(c) for c in numeric]).first()
    return tuple(sorted(c for c in numeric if varied[c]))


def label_store(store: DataFrame, bars: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """A feature store (ticker, snapshot_date, features) with what ``study`` needs: the snapshot's number, and of the ticker's last bar up to that day its date, close and return over the next ``horizon`` bars (null while they haven't passed, or without a bar).

    One shuffle by ticker: bars and stored rows are put in order of time, and each stored row takes the bar before it. Stored columns of the added names are replaced.
    """
    own = Window.partitionBy("ticker").orderBy("date")
    ahead = F.lead("close", horizon).over(own) / F.nullif("close", F.lit(0.0)) - 1
    bar = F.struct(F.col("date").alias("bar_date"), "close", ahead.alias("forward"))
    columns = [c for c in store.columns if c not in ("bar_date", "close", "forward", "snapshot")]
    kept_row = F.struct(*columns)
    priced = bars.where("close is not null").select("ticker", "date", F.lit(0).alias("kind"), bar.alias("bar"))
    stored = store.select("ticker", F.col("snapshot_date").cast(bars.schema["date"].dataType).alias("date"), F.lit(1).alias("kind"), kept_row.alias("row"))
    before = Window.partitionBy("ticker").orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = priced.unionByName(stored, allowMissingColumns=True).withColumn("bar", F.last("bar", ignorenulls=True).over(before)).where("kind = 1")
    days = store.select("snapshot_date").distinct().withColumn("snapshot", F.row_number().over(Window.orderBy("snapshot_date")) - 1)
    return found.select("row.*", "bar.*").join(F.broadcast(days), "snapshot_date")  # a row per day


#: The panel's snapshots, numbered in order, with their rows.
PANEL_DAYS = Rel("panel_days", "SELECT snapshot, n, row_number() OVER (ORDER BY snapshot) - 1 AS t FROM (SELECT snapshot, count(*) AS n FROM panel GROUP BY snapshot) x", (PANEL,))
LEAST_TRAIN, LEAST_TEST = 100, 20  # rows of a fold's parts


def folds(every: int = STEP, horizon: int = HORIZON, embargo: int = EMBARGO, splits: int = SPLITS, panel_days: Rel = PANEL_DAYS) -> Rel:
    """Walk-forward folds over the panel's snapshots, which lie ``every`` trading days apart: consecutive test blocks; training ends a horizon and an embargo before its block."""
    gap = -(-horizon // every) + -(-embargo // every)  # snapshots that horizon and embargo span
    return Rel(
        "folds",
        lambda q: f"""
        SELECT fold, test_from, test_to, train_to
        FROM (SELECT fold, test_from, CASE WHEN fold = {splits - 1} THEN n ELSE test_from + size END AS test_to, test_from - {gap} AS train_to
              FROM (SELECT f.fold, n, size, n - ({splits} - f.fold) * size AS test_from
                    FROM (SELECT count(*) AS n, greatest(1, cast(floor((count(*) - 20) / {splits + 1}e0) AS bigint)) AS size FROM {panel_days.name}) c
                    CROSS JOIN (SELECT {q.explode(q.numbers("0", str(splits - 1)))} AS fold) f WHERE n >= 20 + {splits} + {gap}) x
              WHERE test_from - {gap} >= 20) y
        JOIN {panel_days.name} d ON d.t < y.test_to
        GROUP BY fold, test_from, test_to, train_to
        HAVING sum(CASE WHEN d.t < train_to THEN d.n ELSE 0 END) >= {LEAST_TRAIN} AND sum(CASE WHEN d.t >= test_from THEN d.n ELSE 0 END) >= {LEAST_TEST}""",
        (panel_days,),
    )


FOLDS = folds()
_ORDERED = Rel("panel_ordered", "SELECT p.*, d.t FROM panel p JOIN panel_days d ON d.snapshot = p.snapshot", (PANEL, PANEL_DAYS))
READY = Rel(
    "readiness",
    f"SELECT count(*) AS snapshots, (max(g) - min(g)) AS span, count(*) >= 30 AND max(g) - min(g) >= {HORIZON + 20} AS can_train, count(*) >= 60 AND max(g) - min(g) >= 120 AS can_validate, round(100e0 * least(1e0, count(*) / 60e0), 4) AS progress FROM (SELECT snapshot, snapshot * {STEP} AS g FROM snapshots GROUP BY snapshot) x",
    (SNAPSHOTS,),
)
#: Ranks of each snapshot by score, and each security's row of the snapshot before the latest that it was in.
RANKED = Rel("snapshot_ranks", "SELECT ticker, snapshot, score, row_number() OVER (PARTITION BY snapshot ORDER BY score DESC NULLS LAST, ticker) AS rank, count(*) OVER (PARTITION BY snapshot) AS n, (SELECT max(snapshot) FROM snapshots) AS latest FROM snapshots", (SNAPSHOTS,))
DELTAS = Rel(
    "deltas",
    lambda q: f"""
    SELECT c.ticker, c.rank, c.score, p.snapshot AS seen, p.ticker IS NULL AS is_new, c.score - p.score AS score_change, p.rank AS prev_rank, {q.half_even("p.rank / cast(p.n AS double) * c.n - c.rank")} AS rank_change
    FROM (SELECT * FROM snapshot_ranks WHERE snapshot = latest) c
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY snapshot DESC) AS r FROM snapshot_ranks WHERE snapshot < latest) x WHERE r = 1) p ON p.ticker = c.ticker""",
    (RANKED,),
)

CUTS = REG.cuts = (*CUTS, SNAPSHOTS, PANEL)
REG.rel("ml_snapshots", "SELECT ticker, snapshot, bar_date, " + ", ".join(f"round({f}, 5) AS {f}" for f in FEATURES) + " FROM snapshots", SNAPSHOTS)
REG.rel("ml_labels", "SELECT ticker, snapshot, round(forward, 6) AS forward, round(excess, 6) AS excess FROM labelled", LABELLED)
REG.rel("ml_ic_days", "SELECT feature, snapshot, n, round(ic, 6) AS ic FROM ic_days", IC_DAYS)
REG.rel("ml_ic", "SELECT feature, round(ic_mean, 6) AS ic_mean, round(ic_sd, 6) AS ic_sd, round(icir, 5) AS icir, periods FROM ic", IC)
REG.rel("ml_learned_weights", "SELECT feature, round(weight, 4) AS weight FROM learned_weights", LEARNED)
REG.rel("ml_panel", "SELECT ticker, snapshot, round(y, 6) AS y, " + ", ".join(f"round(x_{f}, 6) AS x_{f}" for f in FEATURES) + " FROM panel", PANEL)
REG.rel("ml_folds", "SELECT fold, test_from, test_to, train_to FROM folds", FOLDS)
REG.rel("ml_fold_rows", "SELECT f.fold, CASE WHEN p.t < f.train_to THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM panel_ordered p CROSS JOIN folds f WHERE p.t < f.train_to OR (p.t >= f.test_from AND p.t < f.test_to) GROUP BY 1, 2", _ORDERED, FOLDS)
REG.rel("ml_readiness", "SELECT * FROM readiness", READY)


def sequences(window: int = 10, least: int | None = None) -> Rel:
    """Each panel row with its ticker's last ``window`` rows of all features (x_f_0 the row itself), padded with the first one; rows with fewer than ``least`` (a whole window) before and including them go."""
    by = "OVER (PARTITION BY ticker ORDER BY snapshot)"
    steps = [f"CASE WHEN k > {j} THEN lag(x_{f}, {j}) {by} ELSE first_value(x_{f}) {by} END AS x_{f}_{j}" for f in FEATURES for j in range(window)]
    return Rel("sequences", f"SELECT * FROM (SELECT ticker, snapshot, y, k, {', '.join(steps)} FROM (SELECT *, row_number() {by} AS k FROM panel) x) z WHERE k >= {window if least is None else least}", (PANEL,))


REG.rel("ml_sequences", "SELECT ticker, snapshot, round(y, 6) AS y, " + ", ".join(f"round(x_{f}_{j}, 6) AS x_{f}_{j}" for f in FEATURES for j in range(5)) + " FROM sequences", sequences(5, 2))
REG.rel("dl_last_seen", "SELECT ticker, max(snapshot) AS last_snapshot, count(*) AS n_snapshots, max_by(rank, snapshot) AS rank, max_by(n, snapshot) AS n, round(max_by(rank / cast(n AS double), snapshot), 6) AS percentile FROM snapshot_ranks WHERE snapshot < latest GROUP BY ticker", RANKED)
REG.rel("dl_counts", "SELECT sum(CASE WHEN rank_change > 0 THEN 1 ELSE 0 END) AS up, sum(CASE WHEN rank_change < 0 THEN 1 ELSE 0 END) AS down, sum(CASE WHEN rank_change = 0 THEN 1 ELSE 0 END) AS same, sum(CASE WHEN is_new THEN 1 ELSE 0 END) AS new, count(*) AS n FROM deltas", DELTAS)
REG.rel("dl_deltas", "SELECT ticker, rank, prev_rank, seen, is_new, round(score_change, 6) AS score_change, rank_change FROM deltas", DELTAS)
_NOISE = quantiles("noise", DELTAS, {"median_change": ("abs(score_change)", 0.5), "p90_change": ("abs(score_change)", 0.9)})
REG.rel("dl_noise", "SELECT (SELECT count(score_change) FROM deltas) AS n, round(median_change, 6) AS median_change, round(p90_change, 6) AS p90_change FROM noise WHERE (SELECT count(score_change) FROM deltas) >= 20", _NOISE, DELTAS)
#: Values count as distinct to the digits that ml_snapshots shows; later ones are the order of sums. Shares of whole volumes tie at the sixth digit, so both engines round them alike.
REG.rel("ml_constant_features", lambda q: "SELECT " + ", ".join(f"count(DISTINCT {q.binary_round(f, 5)}) AS n_{f}" for f in FEATURES) + " FROM snapshots", SNAPSHOTS)

#: The feature store's wide row: raw value, presence and score of every factor, penalties as 0 or 1.
_W = RUN["weighted"]
_IDS = [f.id for f in DEFAULT.factors if f.id in FORMULAS]
FEATURE_MATRIX = Rel(
    "feature_matrix",
    "SELECT w.ticker, " + ", ".join(f"max(CASE WHEN w.factor_id = '{f}' THEN w.raw END) AS raw_{f}, max(CASE WHEN w.factor_id = '{f}' THEN w.score END) AS score_{f}, max(CASE WHEN w.factor_id = '{f}' AND w.raw IS NOT NULL THEN 1 ELSE 0 END) AS has_{f}" for f in _IDS)
    + ", " + ", ".join(f"max(CASE WHEN p.penalty_{x} THEN 1 ELSE 0 END) AS penalty_{x}" for x in PENALTIES)
    + " FROM weighted w JOIN factors p ON p.ticker = w.ticker GROUP BY w.ticker",
    (_W, FACTORS),
)
REG.rel("ml_feature_matrix", "SELECT ticker, " + ", ".join(f"round(raw_{f}, 6) AS raw_{f}, round(score_{f}, 5) AS score_{f}, has_{f}" for f in _IDS) + ", " + ", ".join(f"penalty_{x}" for x in PENALTIES) + " FROM feature_matrix", FEATURE_MATRIX)
REG.rel("src_previous_snapshot", "SELECT ticker, snapshot, round(score, 6) AS score FROM snapshots WHERE snapshot = (SELECT max(snapshot) FROM snapshots WHERE snapshot < (SELECT max(snapshot) FROM snapshots))", SNAPSHOTS)
#: The same of the bars alone, for the second engine: snapshots have many columns that this doesn't need.
PREVIOUS_ORACLE = Rel(
    "previous_rows",
    lambda q: f"""
    SELECT ticker, s AS snapshot, round(mom63, 6) AS score
    FROM (SELECT b.ticker, t.g, lead(t.g) OVER w AS g_next, (SELECT max(g) FROM trading_days) AS g_last, b.close / nullif(lag(b.close, 63) OVER w, 0) - 1 AS mom63
          FROM bars b JOIN trading_days t ON t.date = b.date WINDOW w AS (PARTITION BY b.ticker ORDER BY b.date)) x
    JOIN (SELECT {q.explode(q.numbers("0", "5000"))} AS s) n ON {STEP} * s >= g AND {STEP} * s < coalesce(g_next, g_last + 1)
    WHERE s = (SELECT cast(floor(max(g) / {STEP}e0) AS bigint) - 1 FROM trading_days)""",
    (BARS, TRADING_DAYS),
)
REG.rel("rp_sparkline", "SELECT ticker, rd, round(close, 8) AS close FROM (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rd FROM bars) x WHERE rd <= 60", BARS)
