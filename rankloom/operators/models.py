"""Rankers, walk-forward evaluation and the promotion gate.

Ridge regression is a Gram matrix summed on the executors and a small solve on the driver; predictions are
column expressions. The challengers are a perceptron and a recurrent net (``neural``), gradient-boosted trees
(``pyspark.ml``) and a ridge over a window of snapshots.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.series import histories, starts
from rankloom.operators import neural
from rankloom.operators.research import CUTS, EMBARGO, FEATURES, FOLDS, HORIZON, LEARNED, PANEL, PANEL_DAYS
from rankloom.plans.numbering import numbered
from rankloom.plans.rel import PLAIN, Registry, kept, written

REG = Registry()
COLUMNS = tuple(f"x_{f}" for f in FEATURES)
#: Fixed value: rows of a day from which it is learnt.
LEAST_DAY = 8
#: Fixed values of the promotion gate: folds, mean IC, ICIR, share of positive folds, lead over the baseline.
GATE = {"folds": 3, "ic": 0.02, "icir": 0.30, "positive": 0.6, "lead": 0.005}


@dataclass(frozen=True)
class Ridge:
    """Standardised linear ranker without intercept."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    sd: tuple[float, ...]
    weights: tuple[float, ...]

    def predict(self) -> Column:
        return sum(((F.col(f) - m) / s * w for f, m, s, w in zip(self.features, self.mean, self.sd, self.weights)), F.lit(0.0))


def fit_ridge(panel: DataFrame, features: tuple[str, ...] = COLUMNS, alpha: float = 10.0, day: str = "snapshot", label: str = "y", by_day: bool = True) -> Ridge | None:
    """None for an empty panel. Features are standardised over all rows; labels are z-scored within a day of LEAST_DAY rows or more (others teach nothing), or with ``by_day`` off taken as they are (the features' means being zero, an intercept changes no weight). Two passes, each one aggregate row."""
    if by_day:
        panel = panel.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(day))).where(f"__n >= {LEAST_DAY}").drop("__n")
    stats = panel.agg(F.count(F.lit(1)).alias("n"), *[a(f).alias(f"{k}{i}") for i, f in enumerate(features) for k, a in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not stats["n"]:
        return None
    mean = [stats[f"m{i}"] for i in range(len(features))]
    sd = [stats[f"s{i}"] or 1.0 for i in range(len(features))]
    own = Window.partitionBy(day)
    spread = F.stddev_pop(label).over(own)
    y = F.when(spread > 0, (F.col(label) - F.avg(label).over(own)) / spread).otherwise(0.0) if by_day else F.col(label)
    z = panel.select(*[((F.col(f) - m) / s).alias(f"z{i}") for i, (f, m, s) in enumerate(zip(features, mean, sd))], y.alias("zy"))
    k = len(features)
    sums = z.agg(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(F.col(f"z{i}") * F.col("zy")).alias(f"b{i}") for i in range(k)]).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    w = np.linalg.solve(gram + alpha * np.eye(k), np.array([sums[f"b{i}"] for i in range(k)]))
    return Ridge(tuple(features), tuple(mean), tuple(sd), tuple(float(x) for x in w))


def learn_weights(panel: DataFrame, fallback: DataFrame, least: int = 50, features: tuple[str, ...] = COLUMNS) -> dict[str, float]:
    """Weights from a ridge's positive coefficients, normalised to 100; those of ``fallback`` (feature, weight) for fewer rows or none positive."""
    m = fit_ridge(panel, features, by_day=False) if panel.limit(least).count() == least else None
    positive = {f.removeprefix("x_"): max(0.0, w) for f, w in zip(m.features, m.weights)} if m else {}
    if not any(positive.values()):
        return {r["feature"]: r["weight"] for r in fallback.collect()}
    return {f: 100 * w / sum(positive.values()) for f, w in positive.items()}


def daily_metrics(predicted: DataFrame, day: str = "snapshot", label: str = "y", key: str = "ticker", least: int = 10) -> DataFrame:
    """Per day with at least ``least`` rows: ordinal-rank IC, the label's mean in the top decile of ``prediction``, and its spread to the bottom decile."""
    by = Window.partitionBy(day)
    rows = predicted.withColumns({
        "n": F.count(F.lit(1)).over(by), "rp": F.row_number().over(by.orderBy("prediction", key)), "ry": F.row_number().over(by.orderBy(label, key)),
    }).where(f"n >= {least}").withColumn("k", F.greatest(F.lit(1), F.floor(0.1 * F.col("n"))))
    ic = F.covar_pop("rp", "ry") / F.nullif(F.stddev_pop("rp") * F.stddev_pop("ry"), F.lit(0.0))
    top, bottom = F.avg(F.when(F.col("rp") > F.col("n") - F.col("k"), F.col(label))), F.avg(F.when(F.col("rp") <= F.col("k"), F.col(label)))
    return rows.groupBy(day).agg(F.count(F.lit(1)).alias("n"), ic.alias("ic"), top.alias("decile_return"), (top - bottom).alias("decile_spread"))


def summary(days: DataFrame, *by: str) -> DataFrame:
    ratio = F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0))
    return days.groupBy(*by).agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_sd"), ratio.alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"), F.avg("decile_return").alias("decile_return"), F.avg("decile_spread").alias("decile_spread"), F.count(F.lit(1)).alias("days"))


def with_window(panel: DataFrame, window: int = 4, features: tuple[str, ...] = COLUMNS) -> tuple[DataFrame, tuple[str, ...]]:
    """Each row with its ticker's previous rows' features beside its own; rows without a full window go."""
    own = Window.partitionBy("ticker").orderBy("snapshot")
    names = {f"{c}_{j}": F.lag(c, j).over(own) for c in features for j in range(1, window)}
    wide = panel.withColumns(names).where(" AND ".join(f"{n} IS NOT NULL" for n in names))
    return wide, (*features, *names)


def trees(train: DataFrame, test: DataFrame, features: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Gradient-boosted trees in place of the perceptron; adds ``prediction``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    put = VectorAssembler(inputCols=list(features), outputCol="v")
    return GBTRegressor(featuresCol="v", labelCol="y", maxIter=10, maxDepth=3, seed=7).fit(put.transform(train)).transform(put.transform(test)).drop("v")


#: Observations of a row that the recurrent net reads, of which so many must be its own (the others repeat the first).
SEQUENCE, LEAST_SEQUENCE = 5, 2
#: Rows that a task hands on at a time.
BATCH_ROWS = 20_000


def _sequences(panel: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """The rows of ``research.sequences`` with their last observations, and the columns from the oldest to the newest. Tasks gather them from whole tickers."""
    names = [f"{c}_{j}" for c in COLUMNS for j in range(SEQUENCE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in histories(batches):
            table, first = table.combine_chunks(), starts(table)
            row = np.arange(table.num_rows)
            first = np.repeat(first, np.diff(np.append(first, table.num_rows)))
            row, first = row[row - first + 1 >= LEAST_SEQUENCE], first[row - first + 1 >= LEAST_SEQUENCE]
            for at in range(0, len(row), BATCH_ROWS):
                own, oldest = row[at : at + BATCH_ROWS], first[at : at + BATCH_ROWS]
                before = [pa.array(np.maximum(own - j, oldest)) for j in range(SEQUENCE)]
                columns = [table.column(c).take(before[0]) for c in ("ticker", "snapshot", "y")] + [table.column(c).take(b) for c in COLUMNS for b in before]
                yield from pa.Table.from_arrays(columns, names=["ticker", "snapshot", "y", *names]).combine_chunks().to_batches()

    ordered = panel.select("ticker", "snapshot", "y", *COLUMNS).repartition("ticker").sortWithinPartitions("ticker", "snapshot")
    kinds = dict(panel.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in ("ticker", "snapshot", "y")] + [f"{c}_{j} {kinds[c]}" for c in COLUMNS for j in range(SEQUENCE)])
    rows = written(ordered.mapInArrow(run, schema), "sequences", **PLAIN)
    return rows, tuple(f"{c}_{j}" for j in reversed(range(SEQUENCE)) for c in COLUMNS)


def walk_forward(panel: DataFrame, folds: DataFrame, model: str = "ridge", features: tuple[str, ...] = COLUMNS, **options) -> DataFrame:
    """Daily metrics of every fold (at most SPLITS, looped over on the driver; each fold runs distributed).

    ``model``: ridge, sequence (a ridge over windows), trees, perceptron or recurrent; the last two train all
    folds in the same rounds and take ``neural.train``'s options.
    """
    if model in neural.NETS:
        return _neural_walk_forward(panel, folds, model, features, options)
    if model == "sequence":
        panel, features = with_window(panel, features=features)
    numbered = panel.join(F.broadcast(PANEL_DAYS.on(panel.sparkSession, panel=panel).select("snapshot", "t")), "snapshot")  # a row per snapshot
    out = None
    for f in folds.orderBy("fold").collect():
        train, test = numbered.where(F.col("t") < f["train_to"]), numbered.where((F.col("t") >= f["test_from"]) & (F.col("t") < f["test_to"]))
        if model == "trees":
            predicted = trees(train, test, features)
        elif (ridge := fit_ridge(train, features)) is None:
            continue
        else:
            predicted = test.withColumn("prediction", ridge.predict())
        days = daily_metrics(predicted).withColumn("fold", F.lit(f["fold"]))
        out = days if out is None else out.unionByName(days)
    return out if out is not None else daily_metrics(numbered.limit(0).withColumn("prediction", F.lit(0.0))).withColumn("fold", F.lit(0))


def _neural_walk_forward(panel: DataFrame, folds: DataFrame, model: str, features: tuple[str, ...], options: dict) -> DataFrame:
    days = PANEL_DAYS.on(panel.sparkSession, panel=panel).select("snapshot", "t")
    if model == "recurrent":
        panel, features = _sequences(panel)
    rows = panel.join(F.broadcast(days), "snapshot")  # a row per snapshot
    found = folds.orderBy("fold").collect()
    blocks = neural.pack(rows, features, SEQUENCE if model == "recurrent" else 1, day="t")
    trained = neural.train(blocks, model, [f["train_to"] for f in found], **options)
    out = daily_metrics(rows.limit(0).withColumn("prediction", F.lit(0.0))).withColumn("fold", F.lit(0))
    for f, m in zip(found, trained):
        if m is not None:
            test = rows.where((F.col("t") >= f["test_from"]) & (F.col("t") < f["test_to"]))
            out = out.unionByName(daily_metrics(test.withColumn("prediction", m.predict())).withColumn("fold", F.lit(f["fold"])))
    return out


#: Weight of a fully trusted model, and the ICIR at which trust is full.
FULL_WEIGHT, FULL_ICIR = 12.0, 1.0


def suggested_weight(ic: float | None, icir: float | None) -> float:
    """Weight of a model's score: grows with the share of the way from the gate's ICIR to FULL_ICIR; none at or below the gate's IC."""
    trusted = ic is not None and icir is not None and ic > GATE["ic"]
    way = (icir - GATE["icir"]) / (FULL_ICIR - GATE["icir"]) if trusted else 0.0
    return round(FULL_WEIGHT * float(np.clip(way, 0, 1)), 1)


#: What a candidate must reach: name -> (its value, the bound), given its result and the champion's.
DEMANDS = {
    "folds": lambda r, champion: (r["folds"], GATE["folds"]),
    "mean IC": lambda r, champion: (r["ic_mean"], GATE["ic"]),
    "ICIR": lambda r, champion: (r["icir"], GATE["icir"]),
    "positive folds": lambda r, champion: (r["positive_folds"], GATE["positive"] * max(1, r["folds"])),
    "lead over the champion": lambda r, champion: (r["ic_mean"] - champion.get("ic_mean", 0.0), GATE["lead"]) if champion else (0.0, 0.0),
}


def promotion_check(result: dict, baseline: dict | None = None) -> tuple[bool, list[str]]:
    """Whether a model may become champion, and the demands that it misses."""
    known = {k: result.get(k) or 0 for k in ("folds", "ic_mean", "icir", "positive_folds")}
    values = {name: demand(known, baseline) for name, demand in DEMANDS.items()}
    missed = [name for name, (value, bound) in values.items() if value < bound]
    return (not missed and bool(result.get("ok")), missed if result.get("ok") else ["evaluation", *missed])


def promote(registry: str | None, name: str, result: dict) -> str:
    """The registry (JSON) with a new champion; the one before goes to its history."""
    state = json.loads(registry) if registry else {"champion": None, "history": [], "candidates": {}}
    if state["champion"]:
        state["history"].append(state["champion"])
    state["champion"] = {"model": name, **result}
    state["candidates"][name] = result
    return json.dumps(state, sort_keys=True)


def predict_live(ranks: DataFrame, model: Ridge | neural.Trained) -> DataFrame | None:
    """Percentiles (0 to 100) of the newest snapshot's predictions (rows without one stay out); None if a feature is missing."""
    needs = model.features if isinstance(model, Ridge) else model.columns
    if not set(needs) <= set(ranks.columns):
        return None
    scored = ranks.select("ticker", model.predict().alias("prediction")).where("prediction is not null")
    placed, n = numbered(scored, F.asc("prediction"), F.asc("ticker"))
    return placed.select("ticker", "prediction", (100 * (F.col("number") - 1) / max(1, n - 1)).alias("model_score"))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(PANEL, spark, sf_dir, CUTS)


@REG.function
def md_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of a ridge over the whole panel."""
    m = fit_ridge(_panel(spark, sf_dir))
    return spark.createDataFrame(list(zip(m.features, m.mean, m.sd, m.weights)) if m else [], "feature string, mean double, sd double, weight double")


@REG.function
def ml_ridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor weights learnt by ridge, or by information coefficients where that gives none."""
    weights = learn_weights(_panel(spark, sf_dir), LEARNED.over(spark, sf_dir, CUTS))
    return spark.createDataFrame(list(weights.items()), "feature string, weight double")


@REG.function
def md_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fold: IC, ICIR, hit rate and decile spread of ridges fitted before it."""
    panel = _panel(spark, sf_dir)
    return summary(walk_forward(panel, FOLDS.on(spark, panel=panel)), "fold")


@REG.function
def md_sequence_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a ridge over windows of four snapshots."""
    panel = _panel(spark, sf_dir)
    return summary(walk_forward(panel, FOLDS.on(spark, panel=panel), "sequence"), "fold")


@REG.function
def md_trees_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for gradient-boosted trees."""
    panel = _panel(spark, sf_dir)
    return summary(walk_forward(panel, FOLDS.on(spark, panel=panel), "trees"), "fold")


#: Rounds of gradients in the registered queries.
ROUNDS = 30


@REG.function
def md_perceptron_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for perceptrons."""
    panel = _panel(spark, sf_dir)
    return summary(walk_forward(panel, FOLDS.on(spark, panel=panel), "perceptron", rounds=ROUNDS), "fold")


@REG.function
def md_recurrent_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for recurrent nets over the last five snapshots of each security."""
    panel = _panel(spark, sf_dir)
    return summary(walk_forward(panel, FOLDS.on(spark, panel=panel), "recurrent", rounds=ROUNDS), "fold")


@REG.function
def md_perceptron_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the newest snapshot by a perceptron that is validated, then fitted anew on all snapshots."""
    panel = _panel(spark, sf_dir)
    newest = panel.agg(F.max("snapshot").alias("snapshot")).first()["snapshot"]
    (model,) = neural.train(neural.pack(panel, COLUMNS), "perceptron", [(newest or 0) + 1], rounds=ROUNDS, refit=True)
    empty = spark.createDataFrame([], "ticker string, prediction double, model_score double")
    return empty if model is None else predict_live(panel.where(F.col("snapshot") == newest), model)


@REG.function
def md_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and suggested weight of the ridge."""
    panel = _panel(spark, sf_dir)
    folds = summary(walk_forward(panel, FOLDS.on(spark, panel=panel)), "fold").collect()
    ics = [f["ic_mean"] for f in folds if f["ic_mean"] is not None]
    sd = float(np.std(ics, ddof=1)) if len(ics) > 1 else 0.0
    result = {"ok": bool(ics), "folds": len(ics), "ic_mean": float(np.mean(ics)) if ics else 0.0, "icir": float(np.mean(ics)) / sd if sd else 0.0, "positive_folds": sum(x > 0 for x in ics)}
    ok, against = promotion_check(result)
    return spark.createDataFrame([("ridge", HORIZON, EMBARGO, result["folds"], result["ic_mean"], result["icir"], ok, ", ".join(against), suggested_weight(result["ic_mean"], result["icir"]))], "model string, horizon int, embargo int, folds int, ic_mean double, icir double, promoted boolean, against string, weight double")


@REG.function
def md_predict_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model percentiles of the newest snapshot in the panel."""
    panel = _panel(spark, sf_dir)
    newest = panel.join(F.broadcast(panel.agg(F.max("snapshot").alias("snapshot"))), "snapshot", "left_semi")
    return predict_live(newest, fit_ridge(panel))


@REG.function
def sc_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores again with the model's percentile as one more factor."""
    from rankloom.operators.factors import FACTOR_VALUES, FACTORS, PENALTY_FLAGS
    from rankloom.operators.scoring import score

    factors = kept(FACTORS, spark, sf_dir, CUTS)
    values, flags = FACTOR_VALUES.on(spark, factors=factors), PENALTY_FLAGS.on(spark, factors=factors)
    live = md_predict_live(spark, sf_dir).select("ticker", "model_score")
    model = factors.select("ticker", "sector").join(live, "ticker", "left").select("ticker", "sector", F.lit("model_score").alias("factor_id"), F.col("model_score").alias("raw"))
    return score(values.unionByName(model), flags).select("ticker", "sector", "base", "penalty", "total_score", "coverage", "rank")
