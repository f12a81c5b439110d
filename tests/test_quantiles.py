"""Exact quantiles against numpy, for odd and even counts, ties and columns that don't fit one list."""

import numpy as np
import pytest

from rankloom.functions import quantiles
from rankloom.functions.quantiles import exact_quantiles


@pytest.mark.parametrize("listed", [100_000, 50])
@pytest.mark.parametrize("n", [1, 2, 3, 10, 4001, 20_000])
def test_quantiles_equal_numpy(spark, n, listed):
    rng = np.random.default_rng(n)
    a, b, c = rng.normal(size=n), rng.integers(0, 5, n).astype(float), np.where(rng.random(n) < 0.7, 1.0, rng.lognormal(size=n))
    rows = [(float(x), float(y), float(z), None) for x, y, z in zip(a, b, c)] + [(None, float("nan"), None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    shares = {"a": (0.5, 0.9), "b": (0.5, 0.25), "c": (0.5, 0.999)}
    got = exact_quantiles(df, {f"{k}{i}": (k, p) for k, ps in shares.items() for i, p in enumerate(ps)} | {"d": ("d", 0.5), "e": ("abs(a)", 0.5)}, listed=listed)
    for k, v in (("a", a), ("b", b), ("c", c)):
        for i, p in enumerate(shares[k]):
            assert got[f"{k}{i}"] == pytest.approx(np.quantile(v, p), abs=1e-12)
    assert got["d"] is None and got["e"] == pytest.approx(np.median(abs(a)))
    assert exact_quantiles(df, {}) == {}


def test_all_columns_share_few_passes(spark, monkeypatch):
    seen, counted = [], quantiles._counted
    monkeypatch.setattr(quantiles, "_counted", lambda rows, asked: seen.append(len(asked)) or counted(rows, asked))
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=999), [-0.0, 0.0, -1e300, 1e300, -5e-324, float("inf")]])
    df = spark.createDataFrame([(float(v), float(-v)) for v in x], "a double, b double")
    got = quantiles.exact_quantiles(df, {"a": ("a", 0.5), "b": ("b", 0.3), "low": ("a", 0.0), "high": ("a", 1.0)}, listed=3)
    assert got["a"] == np.median(x) and got["b"] == pytest.approx(np.quantile(-x, 0.3)) and (got["low"], got["high"]) == (-1e300, np.inf)
    assert len(seen) <= 5
