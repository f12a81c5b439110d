"""The profile that tasks compute in numpy against the same as one statement of windows, on odd histories."""

import datetime
import random
import re
from dataclasses import replace

import pytest
from rankloom.functions import series
from rankloom.operators.profile import PROFILE, STATED, SUPERTREND, SUPERTREND_SERIES
from rankloom.operators.research import MARKED, SNAPSHOTS

SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


def history(ticker, n, seed, gaps=0.0, flat=0, step=3.0, drop=0):
    """n bars; ``gaps``: share of missing figures, ``flat``: last bars without a move, ``drop``: a fall every so many bars only."""
    dice, price, out = random.Random(seed), 50.0, []
    lost = lambda x: None if dice.random() < gaps else x
    for i in range(n):
        if i < n - flat:
            price = price + (-1 if drop and i % drop == 0 else 1) * 0.01 if drop else round(abs(price + dice.uniform(-step, step)), 1)
        wide = 0.0 if i >= n - flat else round(dice.uniform(0, 2), 1)
        out.append((ticker, datetime.date(2010, 1, 1) + datetime.timedelta(days=i), lost(price), lost(price + wide), lost(price - wide), lost(price), lost(float(dice.randrange(5)))))
    return out


ODD = [
    history("short", 1, 1), history("pair", 2, 2), history("month", 31, 3), history("half", 140, 4, gaps=0.2), history("year", 300, 5), history("gaps", 700, 6, gaps=0.3),
    history("flat", 400, 7, flat=400), history("still", 500, 8, flat=90), history("stood", 460, 18, flat=300), history("rise", 2600, 9, drop=2200), history("long", 3300, 10, gaps=0.02),
    history("zeros", 280, 11, step=60.0), history(None, 90, 12), [("dry", d, None, None, None, c, None) for _, d, _, _, _, c, _ in history("dry", 200, 13)],
    [("nil", d, 0.0, 0.0, 0.0, 0.0, 0.0) for _, d, *_ in history("nil", 130, 14)],
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [r for h in ODD for r in h]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def same(got, want):
    got, want = ({r.ticker: r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and len(want) == len(ODD)
    return [(t, c, got[t][c], x) for t, row in want.items() for c, x in row.items() if not (got[t][c] == x or (isinstance(x, float) and got[t][c] is not None and got[t][c] == pytest.approx(x, rel=1e-9, abs=1e-9)))]


def test_odd_histories_equal_the_statement(spark, odd):
    got, want = PROFILE.on(spark, bars=odd).drop("last_supertrend"), STATED.on(spark, bars=odd)
    assert got.dtypes == want.dtypes
    assert same(got, want) == []


def test_last_direction_of_supertrend_equals_the_series(spark, odd):
    last = {r.ticker: r.date for r in odd.where("close IS NOT NULL").groupBy("ticker").agg({"date": "max"}).toDF("ticker", "date").collect()}
    want = {r.ticker: r.dir for r in SUPERTREND_SERIES.on(spark, bars=odd).collect() if r.ticker is not None and last[r.ticker] == r.date}
    got = SUPERTREND.on(spark, bars=odd)
    assert len(re.findall("Exchange hashpartitioning", got._jdf.queryExecution().executedPlan().toString())) == 1  # the bars are dealt once
    assert {r.ticker: r.supertrend for r in got.collect()} == want and len(set(want.values())) == 2 and len(want) < len(ODD)


def test_marks_of_bars_equal_the_statement(spark, odd):
    """A bar without a day counts for the indicators, as in the statement."""
    bars = odd.unionByName(spark.createDataFrame([("year", None, 3.0, 9.0, 2.0, 4.0, 5.0)], SCHEMA)).where("ticker IS NOT NULL")
    found = [{(r.ticker, r.snapshot): r.asDict() for r in x.on(spark, bars=bars).collect()} for x in (SNAPSHOTS, replace(SNAPSHOTS, inputs=(replace(MARKED, run=None, reads=()),)))]
    assert found[0].keys() == found[1].keys() and len(found[0]) > 300
    assert [(k, c) for k, row in found[1].items() for c, x in row.items() if not (found[0][k][c] == x or (isinstance(x, float) and found[0][k][c] is not None and found[0][k][c] == pytest.approx(x, rel=1e-9, abs=1e-9)))] == []


def test_histories_that_span_batches_and_matrices(spark, odd, monkeypatch):
    batches = odd.where("close IS NOT NULL").sort("ticker", "date").toArrow().to_batches(max_chunksize=7)
    tables = list(series.histories(iter(batches), rows=500))
    assert sum(t.num_rows for t in tables) == odd.where("close IS NOT NULL").count() and len(tables) > 5
    assert sum(len(series.starts(t)) for t in tables) == len(ODD)  # no ticker is cut
    monkeypatch.setattr(series, "CELLS", 1000)
    cells = [(len(first), int(length.max())) for t in tables for first, length, _ in series.matrices(t, ("close",))]
    assert sum(n for n, _ in cells) == len(ODD) and all(n == 1 or n * width <= 1000 for n, width in cells)


def test_bars_stay_narrow(spark, odd):
    """No window carries more than the bar's own columns and its number."""
    text = PROFILE.on(spark, bars=odd)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?m)[ +-]Window \[", text)) == 1 and "MapInArrow" in text
