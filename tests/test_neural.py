"""Rankers trained by rounds of gradients: finite differences, split days, planted signals, stores."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.operators import neural
from rankloom.operators.models import daily_metrics, fit_ridge
from rankloom.operators.neural import Perceptron, Recurrent, correlation, load, loss_slope, moments, pack, save, train

COLUMNS = tuple(f"x{i}" for i in range(5))


@pytest.mark.parametrize("net", [Perceptron(4, hidden=6, dropout=0.0), Recurrent(3, hidden=5, dropout=0.0, steps=4)])
def test_gradients_equal_finite_differences(net):
    rng = np.random.default_rng(1)
    x, t = rng.normal(size=(9, net.features * net.steps)), rng.normal(size=9)
    theta = net.start(3) + rng.normal(scale=0.1, size=len(net.start(3)))
    loss = lambda v: -correlation(moments(net.forward(v, x)[0], t))
    p, kept = net.forward(theta, x)
    got = net.backward(kept, loss_slope(p, t, moments(p, t)))
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        assert got[i] == pytest.approx((loss(theta + step) - loss(theta - step)) / 2e-6, abs=2e-6)


def panel(spark, told, seed=5, days=40, n=60, steps=1):
    rng, rows = np.random.default_rng(seed), []
    walk = rng.normal(size=(days + steps, n, 5))
    for d in range(days):
        now = walk[d + steps - 1]
        y = told(walk[d : d + steps]) + rng.normal(scale=0.5, size=n)
        seen = walk[d : d + steps].transpose(1, 0, 2).reshape(n, -1)
        rows += [(f"T{i:03d}", d, float(y[i]), *map(float, seen[i])) for i in range(n)]
        assert len(now) == n
    names = COLUMNS if steps == 1 else [f"x{i}_{steps - 1 - s}" for s in range(steps) for i in range(5)]
    return spark.createDataFrame(rows, "ticker string, snapshot long, y double, " + ", ".join(f"{c} double" for c in names)), tuple(names)


def mean_ic(frame):
    return daily_metrics(frame).agg(F.avg("ic")).first()[0]


def test_perceptron_finds_what_a_line_cannot(spark):
    p, names = panel(spark, lambda w: 1.5 * w[-1][:, 0] * w[-1][:, 1])
    (model,) = train(pack(p, names), "perceptron", [30], rounds=60)
    test = p.where("snapshot >= 30")
    ic, line = mean_ic(test.withColumn("prediction", model.predict())), mean_ic(test.withColumn("prediction", fit_ridge(p.where("snapshot < 30"), names).predict()))
    assert ic > 0.4 and abs(line) < 0.2
    assert model.history and all(h["loss"] <= 1 for h in model.history)


def test_recurrent_finds_changes(spark):
    p, names = panel(spark, lambda w: 1.5 * (w[-1][:, 0] - w[-2][:, 0]) * np.sign(w[-1][:, 1]), steps=3, days=40)
    (model,) = train(pack(p, names, steps=3), "recurrent", [32], rounds=70)
    ic = mean_ic(p.where("snapshot >= 32").withColumn("prediction", model.predict()))
    assert ic > 0.3


def test_days_in_several_blocks_train_as_whole_ones(spark):
    p, names = panel(spark, lambda w: w[-1][:, 0], days=8, n=40)
    whole, split = pack(p, names), pack(p, names, block=16)
    assert split.split and not whole.split and split.frame.count() == 24
    a, b = (train(x, "perceptron", [6, 8], rounds=6, dropout=0.0) for x in (whole, split))
    for x, y in zip(a, b):
        assert np.allclose(x.theta, y.theta, atol=1e-8) and np.allclose([h["loss"] for h in x.history], [h["loss"] for h in y.history], atol=1e-6)


def test_many_tasks_add_up_on_the_executors(spark, monkeypatch):
    p, names = panel(spark, lambda w: w[-1][:, 0], days=8, n=20)
    blocks = pack(p, names)
    (a,) = train(blocks, "perceptron", [8], rounds=4, dropout=0.0)
    monkeypatch.setattr(neural, "PARTIALS", 0)
    (b,) = train(blocks, "perceptron", [8], rounds=4, dropout=0.0)
    assert np.allclose(a.theta, b.theta, atol=1e-9)


def test_noise_empty_and_nulls(spark):
    p, names = panel(spark, lambda w: 0 * w[-1][:, 0], days=30, n=30)
    (model,) = train(pack(p, names), "perceptron", [24], rounds=20)
    assert abs(mean_ic(p.where("snapshot >= 24").withColumn("prediction", model.predict()))) < 0.15
    assert train(pack(p.limit(0), names), "perceptron", [24]) == [None]
    assert pack(p.where("ticker < 'T005'"), names).days == {}
    holes = p.withColumn("x0", F.when(F.col("ticker") != "T001", F.col("x0")))
    assert holes.withColumn("p", model.predict()).where("(p is null) <> (x0 is null)").count() == 0
    assert pack(holes.unionByName(p.withColumn("snapshot", F.col("snapshot") + 100)), names).days[100][0] == 30


def test_models_are_stored_and_refitted(spark, tmp_path):
    p, names = panel(spark, lambda w: w[-1][:, 0], days=20, n=20)
    blocks, path = pack(p, names), f"file://{tmp_path}/models"
    (first,), (refitted,) = train(blocks, "perceptron", [20], rounds=12), train(blocks, "perceptron", [20], rounds=12, refit=True)
    assert not np.allclose(first.mean, refitted.mean)  # all days, not the first four fifths
    save(spark, path, "perceptron", first, 1)
    save(spark, path, "perceptron", refitted, 2)
    other = spark.newSession()
    again = load(other, path, "perceptron")
    assert np.array_equal(again.theta, refitted.theta) and np.array_equal(load(other, path, "perceptron", 1).theta, first.theta)
    a, b = (sorted(map(tuple, p.select("ticker", "snapshot", m.predict().alias("p")).collect())) for m in (refitted, again))
    assert a == b
    with pytest.raises(KeyError):
        load(spark, path, "other")


def test_recurrent_blocks_are_computed_in_chunks_and_validation_once(monkeypatch):
    net, rng, seen = Recurrent(3, hidden=5, dropout=0.0, steps=4), np.random.default_rng(2), []
    theta, x, y = net.start(3), rng.normal(size=(1500, 12)).astype("<f4"), rng.normal(size=1500)
    p, kept = net.forward(theta, x.astype(np.float64))
    m = moments(p, y)
    want = net.backward(kept, loss_slope(p, y, m))
    plain = Recurrent.forward
    monkeypatch.setattr(Recurrent, "forward", lambda self, theta, x, rng=None: seen.append(len(x)) or plain(self, theta, x, rng))
    run = neural._Run(0, 1, 2, np.zeros(12), np.ones(12), theta, theta, theta, theta)
    rows = lambda whole: iter([pa.RecordBatch.from_pydict({"day": [0, 1], "part": [0, 0], "whole": [whole] * 2, "x": [x.tobytes()] * 2, "y": [y.tobytes()] * 2})])
    (out,) = neural._pass(net, [run], 7, 1, None)(rows(True))
    assert np.allclose(out["sums"][0].as_py()[:-1], want, atol=1e-5) and max(seen) <= Recurrent.chunk and sum(seen) == 3000
    seen.clear()
    (out,) = neural._pass(net, [run], 7, 1, {(0, 0): m, (0, 1): m})(rows(False))
    assert np.allclose(out["sums"][0].as_py()[:-1], want, atol=1e-5) and sum(seen) == 1500  # the day that only validates isn't computed again


def test_perceptron_blocks_are_computed_in_chunks(monkeypatch):
    net, rng, seen = Perceptron(5, dropout=0.0), np.random.default_rng(3), []
    theta, x, y = net.start(3), rng.normal(size=(5000, 5)).astype("<f4"), rng.normal(size=5000)
    p, kept = net.forward(theta, x.astype(np.float64))
    m = moments(p, y)
    want = net.backward(kept, loss_slope(p, y, m))
    plain = Perceptron.forward
    monkeypatch.setattr(Perceptron, "forward", lambda self, theta, x, rng=None: seen.append(len(x)) or plain(self, theta, x, rng))
    run = neural._Run(0, 1, 2, np.zeros(5), np.ones(5), theta, theta, theta, theta)
    for whole, of_days in ((True, None), (False, {(0, 0): m})):
        seen.clear()
        batch = pa.RecordBatch.from_pydict({"day": [0], "part": [0], "whole": [whole], "x": [x.tobytes()], "y": [y.tobytes()]})
        (out,) = neural._pass(net, [run], 7, 1, of_days)(iter([batch]))
        assert np.allclose(out["sums"][0].as_py()[:-1], want, atol=1e-5) and max(seen) <= Perceptron.chunk < 5000 and sum(seen) == 5000


def test_extreme_inputs_saturate():
    for net in (Perceptron(2, dropout=0.0), Recurrent(2, dropout=0.0, steps=2)):
        p, kept = net.forward(net.start(1).astype("f4"), np.full((3, 2 * net.steps), 1e6, "f4"))
        assert np.isfinite(p).all() and np.isfinite(net.backward(kept, np.array([1.0, -2.0, 1.0]))).all()
