"""Upserts, retention, cleaning, encryption, leak scan, HTML symbols and the streaming extension."""

import datetime

from pyspark.sql import functions as F

from rankloom.sources import store
from rankloom.streaming.ingest import bar_batches, mention_windows


def test_snapshot_merge_and_positions(spark):
    old = spark.createDataFrame([("A", 50.0, 1), ("B", 40.0, 2)], "ticker string, total_score double, rank int")
    new = spark.createDataFrame([("B", 90.0, None), ("C", None, None)], "ticker string, total_score double, rank int")
    assert {(r.ticker, r.rank) for r in store.merge_snapshot(old, new).collect()} == {("B", 1), ("A", 2), ("C", 3)}
    p = spark.createDataFrame([("A", 10.0, "x"), ("B", 20.0, None)], "ticker string, entry_price double, note string")
    c = spark.createDataFrame([("A", None, "y", False), ("B", None, None, True), ("C", 5.0, None, None)], "ticker string, entry_price double, note string, removed boolean")
    assert {tuple(r) for r in store.update_positions(p, c).collect()} == {("A", 10.0, "y"), ("C", 5.0, None)}


def test_partitions_are_refreshed_and_retained(spark, tmp_path):
    day = lambda d, v: spark.createDataFrame([(datetime.date(2024, 1, d), v)], "date date, v int")
    for d, v in ((1, 1), (2, 2), (1, 3), (1, 3)):
        store.refresh_partitions(spark, day(d, v), f"{tmp_path}/h")
    got = spark.read.parquet(f"{tmp_path}/h")
    assert {(str(r.date), r.v) for r in got.collect()} == {("2024-01-01", 3), ("2024-01-02", 2)}
    assert [str(r.date) for r in store.retain(got, 1).collect()] == ["2024-01-02"]


def test_clean_and_cache(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("-inf"), 2), (2.5, 3), (None, 4)], "x double, k int")
    assert [r.x for r in store.clean(df).orderBy("k").collect()] == [None, None, 2.5, None]
    bars = spark.range(40).select(F.lit("A").alias("ticker"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at")).union(spark.range(5).select(F.lit("B"), F.lit("2024-01-01 00:00:00").cast("timestamp")))
    assert store.cached(bars, "2024-01-01 01:00:00", 7200).count() == 40
    assert store.cached(bars, "2024-01-03 01:00:00", 7200).count() == 0
    assert len(store.cache_key("history", "A")) == 20


def test_encryption_and_leaks(spark):
    df = spark.createDataFrame([("secret text", bytearray(range(12)))], "text string, nonce binary")
    blob = store.encrypt(df, "right", b"0123456789abcdef")
    assert store.decrypt(blob, "right", b"0123456789abcdef").first().text == "secret text"
    assert store.decrypt(blob, "wrong", b"0123456789abcdef").first().text is None
    page = spark.createDataFrame([('<x marker="1">"' + "A" * 120 + 'secret"',), ("secret marker",)], "text string")
    assert [list(r.leaked) for r in store.leaks(page, ["marker"], ["secret"]).collect()][1] == ["secret"]


def test_symbols(spark, tmp_path):
    (tmp_path / "s.txt").write_text("aapl, Apple\n# none\nbrk.b # b\n1bad\n")
    assert {r.symbol for r in store.read_symbols(spark, f"{tmp_path}/s.txt").collect()} == {"AAPL", "BRK-B"}
    cells = "".join(f"<tr><td>{i}</td><td><a>S{chr(65 + i)}</a></td></tr>" for i in range(22))
    page = spark.createDataFrame([(f"<table>{cells}</table><table><tr><td>X</td></tr></table>",), (None,)], "html string")
    assert store.html_symbols(page).count() == 22
    (tmp_path / "m.json").write_text('{"results": [{"ticker": "A", "mentions": 3, "rank": 1}], "pages": 1}')
    assert store.read_mentions(spark, f"{tmp_path}/m.json").first().mentions == 3


def test_streams(spark, tmp_path):
    rows = [("A", datetime.datetime(2024, 1, d, h), 10.0 + h, 5.0) for d in (1, 2) for h in range(3)]
    spark.createDataFrame(rows, "ticker string, ts timestamp, price double, volume double").write.parquet(f"{tmp_path}/ticks")
    ticks = spark.readStream.schema("ticker string, ts timestamp, price double, volume double").parquet(f"{tmp_path}/ticks")
    bar_batches(ticks, f"{tmp_path}/bars", f"{tmp_path}/cp").awaitTermination(120)
    got = {str(r.date): (r.open, r.close, r.volume) for r in spark.read.parquet(f"{tmp_path}/bars").collect()}
    assert got == {"2024-01-01": (10.0, 12.0, 15.0), "2024-01-02": (10.0, 12.0, 15.0)}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parque*")
    q = mention_windows(stream).writeStream.format("memory").queryName("mention_windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(mentions) AS n FROM mention_windows").first().n == events.count()


def test_scan_log_cache_and_positions(spark):
    log = spark.createDataFrame([("A", "2024-01-02"), ("B", "2024-01-05"), ("B", "2024-01-01")], "ticker string, last_scan string")
    scanned = spark.createDataFrame([("a",), ("C",), (None,)], "ticker string")
    assert {tuple(r) for r in store.record_scans(log, scanned, "2024-01-04").collect()} == {("A", "2024-01-04"), ("B", "2024-01-05"), ("C", "2024-01-04")}
    bars = spark.createDataFrame([("A", f"2024-01-{d:02d}", float(d)) for d in range(1, 31)] + [("B", "2024-01-01", 1.0), ("B", "2024-01-02", None)], "ticker string, date string, close double")
    assert [r.ticker for r in store.should_cache(bars).collect()] == ["A"]
    positions = spark.createDataFrame([("A", "2024-01-28", 14.0), ("Z", "2024-01-01", 0.0)], "ticker string, added_date string, entry_price double")
    assert [round(r.pnl_pct, 6) for r in store.position_history(positions, bars).orderBy("date").collect()] == [100.0, round(100 * (29 / 14 - 1), 6), round(100 * (30 / 14 - 1), 6)]
    universe = spark.createDataFrame([("A", 1), ("B", 2)], "ticker string, pos int")
    assert {(r.ticker, r.pinned) for r in store.watchlist(positions, universe).collect()} == {("A", True), ("Z", True), ("B", False)}
    cache = spark.createDataFrame([("p", "k1", "2024-01-01 00:00:00"), ("p", "k2", "2024-01-02 00:00:00"), ("q", "k3", "2024-01-02 00:00:00")], "namespace string, key string, fetched_at string").selectExpr("namespace", "key", "timestamp(fetched_at) AS fetched_at")
    assert {r.key for r in store.purge(cache, "2024-01-02 01:00:00", 7200).collect()} == {"k2", "k3"}
    assert {r.key for r in store.purge(cache, "2024-01-02 01:00:00", 7200, namespace="p").collect()} == {"k3"}


def test_snapshots_and_sentiment(spark, tmp_path):
    for day, more in (("2024-01-01", ""), ("2024-01-02", ", 5 AS extra")):
        store.refresh_partitions(spark, spark.sql(f"SELECT 'A' AS ticker, 1 AS rank, '{day}' AS date{more} UNION ALL SELECT 'B', 2, '{day}'{more[:3]}"), f"{tmp_path}/snapshots")
    rows = store.read_snapshots(spark, f"{tmp_path}/snapshots")
    assert rows.count() == 4 and rows.where("extra is null").count() == 2
    assert [r.ticker for r in store.last_ranking(spark, f"{tmp_path}/snapshots").collect()] == ["A", "B"]
    (tmp_path / "s.json").write_text('[{"ticker": "a", "no_of_comments": 2, "sentiment": "Bullish", "sentiment_score": 0.2}, {"ticker": "A", "no_of_comments": 9, "sentiment": "Bearish", "sentiment_score": -0.1}, {"ticker": null}]')
    assert [tuple(r) for r in store.read_sentiment(spark, str(tmp_path / "s.json")).collect()] == [("A", 9, "Bearish", -0.1)]
    one = spark.range(3).toDF("x")
    status = store.run_status(one, spark.range(10), spark.range(4), spark.range(0)).first()
    assert (status.ranked, status.universe, status.scanned, status.dropped, status.ok, status.scanned_pct) == (3, 10, 4, 0, True, 40.0)


def test_pages_are_checked_before_they_are_published(spark):
    pages = [('x marker "iter": 600000',), ('x marker "iter" : 9000',), ("x marker",), ('x "iter": 600000',), ('marker secret "iter": 600000',), (None,)]
    got = store.publishable(spark.createDataFrame(pages, "text string"), ["marker"], ["secret"]).collect()
    assert [r.ok for r in got] == [True, False, False, False, False, False]
    assert [r.iterations for r in got] == [600000, 9000, 0, 600000, 600000, 0]
