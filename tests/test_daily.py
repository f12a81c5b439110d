"""Carried days equal whole histories; stored states and bars start without a shuffle and survive a dead run."""

import datetime
import math

import pandas as pd
import pytest

from rankloom.operators.daily import COLUMNS, SHOWN, DailyState, advance, begin
from rankloom.operators.profile import PROFILE
from rankloom.sources import layout
from rankloom.sources.snapshots import Conflict
from tests.test_indicators import frame

START = datetime.date(2020, 1, 1)


def day(k):
    return START + datetime.timedelta(days=k)


@pytest.fixture(scope="module")
def bars():
    """A long ticker, one that starts late, one with holes, a flat one, one with missing highs, rows without a close and key."""
    a, late, holes, flat, thin = frame(1, 330, "A"), frame(2, 330, "L"), frame(3, 330, "H"), frame(4, 330, "F"), frame(5, 330, "M")
    late = late[late.date >= day(308)]
    holes = holes[(holes.index % 3 != 0) | (holes.index < 290)]
    flat[["open", "high", "low", "close"]] = 10.0
    thin.loc[thin.index % 7 == 0, ["high", "low"]] = None
    noise = pd.concat([frame(6, 330, "A")[320:].assign(close=None), frame(7, 330, None)[318:]])
    return pd.concat([x.astype(object) for x in (a, late, holes, flat, thin, noise)])


def given(spark, rows):
    columns = ["open", "high", "low", "close", "volume"]
    listed = [[None if x is None or x != x else x for x in r] for r in rows[["ticker", "date", *columns]].values.tolist()]
    return spark.createDataFrame(listed, "ticker string, date date, " + ", ".join(f"{c} double" for c in columns))


def same(got, want):
    got, want = ({r["ticker"]: r for r in x.collect()} for x in (got, want))
    assert got.keys() == want.keys()
    for t in want:
        for c in COLUMNS:
            x, y = got[t][c], want[t][c]
            for p, q in zip(x, y) if isinstance(y, list) else [(x, y)]:
                assert (p is None) == (q is None) and (p is None or p == q or (isinstance(q, float) and math.isclose(p, q, rel_tol=1e-8, abs_tol=1e-8))), (t, c, p, q)
            assert not isinstance(y, list) or len(x) == len(y), (t, c)


def test_thirty_days_carried_equal_a_whole_run(spark, bars, tmp_path):
    frame_ = given(spark, bars)
    store = DailyState(spark, f"{tmp_path}/state", buckets=4)
    assert store.run(frame_.where(f"date < '{day(300)}'")) == [str(day(299))]
    assert store.run(frame_) == [str(day(k)) for k in range(300, 330)]
    for k in (300, 309, 329):  # new tickers have a bar, then ten; holes
        same(store.at(str(day(k))), begin(spark, frame_.where(f"date <= '{day(k)}'")))
    assert store.run(frame_) == [] and len(store.days()) == 31
    last = store.indicators()
    assert last.columns == ["ticker", "date", *SHOWN] and {r.ticker for r in last.collect()} == {"A", "L", "F", "M", "H"}


def test_a_day_twice_old_days_and_no_bars_change_nothing(spark, bars):
    frame_ = given(spark, bars)
    state = begin(spark, frame_.where(f"date < '{day(320)}'"))
    same(advance(state, frame_.where(f"date = '{day(319)}'")), state)
    same(advance(state, frame_.where(f"date = '{day(100)}'")), state)
    same(advance(state, frame_.limit(0)), state)
    assert begin(spark, frame_.limit(0)).count() == 0
    one = frame_.where(f"date = '{day(320)}'")
    same(advance(begin(spark, frame_.limit(0)), one), begin(spark, one))  # from nothing
    same(advance(state, one.unionByName(one)), advance(state, one))  # repeated rows


def test_empty_store_and_two_runs_at_once(spark, bars, tmp_path):
    frame_ = given(spark, bars)
    store = DailyState(spark, f"{tmp_path}/state", buckets=2)
    assert store.run(frame_.limit(0)) == [] and store.days() == []
    store.run(frame_.where(f"date < '{day(310)}'"))
    read_at = store.versions.version()
    other = DailyState(spark, f"{tmp_path}/state", buckets=2)
    other.run(frame_.where(f"date <= '{day(310)}'"))
    with pytest.raises(Conflict):
        store._put(store.at(str(day(309))), str(day(310)), read_at)


def test_a_dead_writer_is_not_read(spark, bars, tmp_path):
    path = f"{tmp_path}/state"
    store = DailyState(spark, path, buckets=2)
    frame_ = given(spark, bars)
    store.run(frame_.where(f"date < '{day(310)}'"))
    store.at().write.parquet(f"{path}/data/dead/state")  # rows without layout and manifest
    with pytest.raises(FileNotFoundError):
        layout.load(spark, f"{path}/data/dead/state")
    assert store.run(frame_.where(f"date <= '{day(310)}'")) == [str(day(310))]
    same(store.at(), begin(spark, frame_.where(f"date <= '{day(310)}'")))


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]


def test_stored_rows_start_without_a_shuffle(spark, bars, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = layout.save(given(spark, bars), f"{tmp_path}/bars", buckets=4)
        assert len(exchanges(PROFILE.on(spark, bars=given(spark, bars)))) > 0
        assert exchanges(PROFILE.on(spark, bars=stored)) == []
        state = layout.save(begin(spark, stored), f"{tmp_path}/state", order=(), buckets=4)
        moved = exchanges(advance(state, given(spark, bars[bars.date == day(329)])))
        assert len(moved) == 1  # the day's bars
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_layout_round_trip_and_age(spark, tmp_path):
    rows = spark.createDataFrame([("B", 2, "2024-05-01 10:00:00"), ("A", 1, "2024-05-01 09:00:00"), (None, 3, "2024-05-01 09:30:00"), ("A", 1, "2024-05-01 09:00:00")], "ticker string, date int, fetched_at string").selectExpr("ticker", "date", "cast(fetched_at AS timestamp) AS fetched_at")
    path = f"{tmp_path}/rows"
    got = layout.save(rows, path, buckets=3)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    kind = layout.layout(spark, path)
    assert (kind.rows, kind.buckets, kind.oldest, kind.newest) == (4, 3, "2024-05-01 09:00:00", "2024-05-01 10:00:00")
    assert layout.fresh(spark, path, "2024-05-01 10:00:00", 3600) and not layout.fresh(spark, path, "2024-05-01 10:00:01", 3600)
    assert {r.ticker for r in layout.stale(spark, path, "2024-05-01 10:15:00", 1800).collect()} == {"A", None}
    with pytest.raises(FileExistsError):
        layout.save(rows, path)
    empty = layout.save(rows.limit(0), f"{tmp_path}/empty", buckets=2)
    assert empty.count() == 0 and not layout.fresh(spark, f"{tmp_path}/empty", "2024-05-01 10:00:00", 60) and layout.layout(spark, f"{tmp_path}/none") is None
