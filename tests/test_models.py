"""Planted signals are learnt, noise isn't, folds don't leak, and the gate holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import models
from rankloom.operators.models import COLUMNS, daily_metrics, fit_ridge, predict_live, promote, promotion_check, suggested_weight, walk_forward, with_window
from rankloom.operators.research import EMBARGO, FOLDS, HORIZON, STEP, feature_columns, folds, label_store, sequences, study
from rankloom.plans.rel import Rel


def panel(spark, strength, seed, days=60, n=60, change=False):
    """Securities with independent features; the label follows 3 parts of the first less 2 of the second, or, with ``change``, what the first gained since the snapshot before."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        shocks = rng.normal(size=(days, len(COLUMNS)))
        features = np.empty_like(shocks)
        for t in range(days):
            features[t] = shocks[t] + (0.6 * features[t - 1] if change and t else 0)
        gained = np.diff(features[:, 0], prepend=features[0, 0])
        told = 1.5 * gained if change else strength * (3 * features[:, 0] - 2 * features[:, 1]) / 2
        label = told + rng.normal(scale=0.8 if change else 1.0, size=days)
        rows += [(f"T{i:03d}", t, float(label[t]), *map(float, features[t])) for t in range(days)]
    return spark.createDataFrame(rows, "ticker string, snapshot long, y double, " + ", ".join(f"{c} double" for c in COLUMNS))


def mean_ic(days):
    return days.agg(F.avg("ic")).first()[0]


def test_signal_and_noise(spark):
    p = panel(spark, 0.55, 1)
    folds = FOLDS.on(spark, panel=p)
    assert folds.count() >= 2
    days = walk_forward(p, folds)
    assert mean_ic(days) > 0.1 and days.agg(F.avg("decile_spread")).first()[0] > 0
    noise = panel(spark, 0, 99)
    assert abs(mean_ic(walk_forward(noise, FOLDS.on(spark, panel=noise)))) < 0.06


def test_folds_keep_a_gap(spark):
    for f in FOLDS.on(spark, panel=panel(spark, 0, 2, days=80, n=3)).collect():
        assert (f.test_from - f.train_to) * STEP >= HORIZON + EMBARGO and f.test_from < f.test_to


def test_windows_see_changes(spark):
    p = panel(spark, 0, 5, change=True)
    folds = FOLDS.on(spark, panel=p)
    plain, wide = mean_ic(walk_forward(p, folds)), mean_ic(walk_forward(p, folds, "sequence"))
    assert wide > 0.1 and wide > plain + 0.05
    assert with_window(p)[0].count() == 60 * 57


def test_ridge_equals_numpy(spark):
    p = panel(spark, 0.5, 3, days=12, n=40)
    rows = p.toPandas()
    x = rows[list(COLUMNS)].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    y = rows.groupby("snapshot").y.transform(lambda v: (v - v.mean()) / v.std(ddof=0)).to_numpy()
    want = np.linalg.solve(z.T @ z + 10 * np.eye(len(COLUMNS)), z.T @ y)
    np.testing.assert_allclose(fit_ridge(p).weights, want, rtol=1e-8)
    assert fit_ridge(p.limit(0)) is None


GOOD = {"ok": True, "ic_mean": 0.06, "icir": 0.8, "folds": 5, "positive_folds": 5}


@pytest.mark.parametrize(("change", "baseline", "ok"), [({}, None, True), ({"ic_mean": 0.005}, None, False), ({"icir": 0.1}, None, False), ({"folds": 2}, None, False), ({"positive_folds": 2}, None, False), ({}, {"ic_mean": 0.058}, False)])
def test_gate(change, baseline, ok):
    assert promotion_check(GOOD | change, baseline)[0] is ok


def test_weights_and_registry():
    assert suggested_weight(None, None) == 0 and 0 <= suggested_weight(0.03, 0.35) < 3 and 8 <= suggested_weight(0.08, 1.2) <= 12
    state = promote(promote(None, "ridge", {"ic": 1}), "trees", {"ic": 2})
    assert '"model": "trees"' in state and '"model": "ridge"' in state


def test_live_predictions(spark):
    p = panel(spark, 0.6, 11, days=30, n=60)
    m = fit_ridge(p)
    newest = p.where("snapshot = 29")
    got = predict_live(newest, m).collect()
    assert len(got) == 60 and min(r.model_score for r in got) == 0 and max(r.model_score for r in got) == 100
    assert predict_live(newest.drop(COLUMNS[0]), m) is None
    assert mean_ic(daily_metrics(newest.withColumn("prediction", m.predict()))) > 0.15
    assert models.GATE["folds"] == 3


def test_learned_weights_and_fallback(spark):
    p = panel(spark, 0.5, 7, days=10, n=30)
    fallback = spark.createDataFrame([("rsi14", 100.0)], "feature string, weight double")
    w = models.learn_weights(p, fallback)
    assert sum(w.values()) == pytest.approx(100) and max(w, key=w.get) == "rsi14" and w["pct_b"] == 0
    assert models.learn_weights(p.limit(20), fallback) == {"rsi14": 100.0}


def test_a_feature_store_is_labelled_and_studied(spark):
    """Stored factor scores lead to labels, coefficients, a panel, folds and a ridge; loops over the definitions say the same."""
    rng, days, n = np.random.default_rng(11), 60, 34
    dates = [f"2024-{1 + d // 28:02d}-{1 + d % 28:02d} 00:00:00" for d in range(days)]
    closes = np.exp(np.cumsum(rng.normal(scale=0.02, size=(n, days)), axis=1))
    bars = spark.createDataFrame([(f"T{i:02d}", dates[d], float(closes[i, d])) for i in range(n) for d in range(days) if i or d % 3], "ticker string, date string, close double").selectExpr("ticker", "cast(date AS timestamp) AS date", "close")
    taken = (9, 20, 31, 58)
    rows = [(f"T{i:02d}", dates[d][:10], None if i == 3 else float(100 * rng.random()), float(i % 2), None if i == 4 else float(rng.random()), 1.0, 7) for d in taken for i in range(n)]
    rows.append(("UNKNOWN", dates[9][:10], 1.0, 0.0, 1.0, 1.0, 7))
    store = spark.createDataFrame(rows, "ticker string, snapshot_date string, score_a double, has_a double, raw_a double, flat double, rank int")
    assert feature_columns(store) == ("has_a", "raw_a", "score_a") and feature_columns(store.select("ticker")) == ()
    labelled = label_store(store.withColumn("close", F.lit(-1.0)), bars, 5).cache()
    assert labelled.count() == len(rows)
    got = {(r.ticker, r.snapshot): r for r in labelled.collect()}
    for i in range(n):
        own = [d for d in range(days) if i or d % 3]
        for s, d in enumerate(taken):
            at = max(k for k, day in enumerate(own) if day <= d)
            ahead = closes[i, own[at + 5]] / closes[i, own[at]] - 1 if at + 5 < len(own) else None
            r = got[f"T{i:02d}", s]
            assert r.close == closes[i, own[at]] and (r.forward is None if ahead is None else r.forward == pytest.approx(ahead))
    assert got["UNKNOWN", 0].close is None and got["UNKNOWN", 0].forward is None
    parts = study(feature_columns(store), Rel("store"))
    panel = parts["panel"].on(spark, store=labelled).toPandas()
    assert sorted(panel.snapshot.unique()) == [0, 1, 2] and len(panel) == 3 * n  # no label yet for the last one
    first = labelled.where("snapshot = 0 AND forward is not null").toPandas()
    order = sorted(zip(first.score_a.fillna(50.0), first.ticker))
    place = {t: 2 * k / (n - 1) - 1 for k, (_, t) in enumerate(order)}
    for r in panel[panel.snapshot == 0].itertuples():
        assert r.x_score_a == pytest.approx(place[r.ticker])
    excess = first.forward - first.forward.mean()
    want = first.score_a.rank().corr(excess[first.score_a.notna()].rank())
    assert parts["ic_days"].on(spark, store=labelled).where("feature = 'score_a' AND snapshot = 0").first().ic == pytest.approx(want)
    assert fit_ridge(parts["panel"].on(spark, store=labelled), ("x_raw_a", "x_score_a")).features == ("x_raw_a", "x_score_a")
    assert fit_ridge(parts["panel"].on(spark, store=labelled.limit(0)), ("x_score_a",)) is None


def test_folds_of_daily_snapshots_keep_horizon_and_embargo(spark):
    p = panel(spark, 0.5, 5, days=140, n=10)
    found = folds(every=1, horizon=10, embargo=5, splits=3).on(spark, panel=p).collect()
    assert found and all(f.test_from - f.train_to == 15 for f in found)


def test_top_decile_return(spark):
    rows = [(0, f"T{i:02d}", float(i), float(i * i)) for i in range(20)]
    r = daily_metrics(spark.createDataFrame(rows, "snapshot long, ticker string, prediction double, y double")).first()
    assert r.decile_return == (18 * 18 + 19 * 19) / 2 and r.decile_spread == r.decile_return - 0.5


def test_neural_rankers_walk_forward(spark):
    p = panel(spark, 0, 5, days=60, n=40, change=True)
    folds = FOLDS.on(spark, panel=p)
    plain = mean_ic(walk_forward(p, folds))
    wide = mean_ic(walk_forward(p, folds, "recurrent", rounds=40))
    assert wide > 0.25 and wide > plain + 0.1
    days = walk_forward(panel(spark, 0.55, 1, n=40), folds, "perceptron", rounds=20)
    assert {r.fold for r in days.collect()} == {r.fold for r in folds.collect()} and mean_ic(days) > 0.1
    assert walk_forward(p.limit(0), FOLDS.on(spark, panel=p.limit(0)), "perceptron").count() == 0


def test_sequences_of_tasks_equal_the_statement(spark, monkeypatch):
    plans, kept = [], models.written
    monkeypatch.setattr(models, "written", lambda df, *rest, **options: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, *rest, **options))
    p = panel(spark, 0.5, 21, days=9, n=7).where("NOT (ticker = 'T003' AND snapshot > 0) AND NOT (ticker = 'T005' AND snapshot % 3 = 1)")
    got, names = models._sequences(p.withColumn("x_adx", F.when(F.col("snapshot") != 4, F.col("x_adx"))))
    want = sequences(models.SEQUENCE, models.LEAST_SEQUENCE).on(spark, panel=p.withColumn("x_adx", F.when(F.col("snapshot") != 4, F.col("x_adx"))))
    columns = ["ticker", "snapshot", "y", *names]
    assert names[0] == f"{COLUMNS[0]}_4" and names[-1] == f"{COLUMNS[-1]}_0"
    rows = sorted(map(tuple, got.select(columns).collect()), key=str)
    assert rows == sorted(map(tuple, want.select(columns).collect()), key=str) and len(rows) > 40
    assert "Window" not in plans[0] and models._sequences(p.limit(0))[0].count() == 0
