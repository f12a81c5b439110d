"""Paged sources: pages that fail, pages that end, refused requests, pruning, streams."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from rankloom.sources.paged import SCHEMA, register


@pytest.fixture(scope="module")
def service(spark):
    """Topic a has three pages, of which the second fails twice; b doesn't tell its pages and has two; c's first page never comes; d refuses; e grows."""
    asked, held = Counter(), {"e": 1}
    sizes = {"a": 3, "b": 2, "c": 2, "d": 3}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_GET(self):
            topic, page = self.path.strip("/").split("/")
            page = int(page)
            asked[topic, page] += 1
            code, last = 200, sizes.get(topic, held.get(topic, 0))
            if (topic, page) == ("a", 2) and asked[topic, page] <= 2:
                code = 503
            if topic == "c":
                code = 500
            if topic == "d" and page == 2:
                code = 429
            rows = [{"ticker": f"{topic.upper()}{page}{i}", "mentions": str(10 * page + i), "rank": i, "rank_24h_ago": ""} for i in range(3)] if page <= last else []
            body = json.dumps({"results": rows, **({"pages": last} if topic in "ad" else {})}).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body if code == 200 else b"no")

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    register(spark)
    yield f"http://127.0.0.1:{server.server_port}/{{topic}}/{{page}}", asked, held
    server.shutdown()


def read(spark, url, **options):
    return spark.read.format("pages").options(url=url, backoff=0.01, **options)


def test_pages_are_read_to_their_end(spark, service):
    url, asked, _ = service
    got = read(spark, url, topics="a,b", pages_per_task=1).load()
    rows = got.collect()
    assert sorted(r.ticker for r in rows) == sorted([f"A{p}{i}" for p in (1, 2, 3) for i in range(3)] + [f"B{p}{i}" for p in (1, 2) for i in range(3)])
    assert {(r.topic, r.page, r.mentions, r.rank, r.rank_24h_ago) for r in rows if r.ticker == "A21"} == {("a", 2, 21, 1, None)}
    assert got.rdd.getNumPartitions() == 4 and asked["a", 2] >= 3
    assert read(spark, url, topics="a", max_pages=2).load().count() == 6


def test_failing_topics_stop_or_fail(spark, service):
    url, asked, _ = service
    before = asked["c", 1]
    assert read(spark, url, topics="c,b").load().where("topic = 'c'").count() == 0
    assert (asked["c", 1] - before) % 3 == 0 and asked["c", 1] > before  # three attempts each time
    before = asked["d", 2]
    assert sorted({r.page for r in read(spark, url, topics="d").load().collect()}) == [1]
    assert asked["d", 2] - before == 1  # a refused request isn't repeated
    with pytest.raises(Exception, match="429"):
        read(spark, url, topics="d", on_error="fail").load().collect()


def test_own_columns_and_topics(spark, service):
    url, asked, _ = service
    got = read(spark, url, topics="a,b,c").schema("rank double, topic string, other string").load()
    before = Counter(asked)
    rows = got.where("topic = 'b'").collect()
    assert len(rows) == 6 and rows[0].asDict() == {"rank": 0.0, "topic": "b", "other": None}
    assert asked["c", 1] == before["c", 1]  # topics that a filter excludes aren't asked for
    assert read(spark, url, topics="none").load().collect() == []


def test_a_stream_takes_new_pages_once(spark, service, tmp_path):
    url, _, held = service

    def run():
        stream = spark.readStream.format("pages").options(url=url, topics="e", backoff=0.01).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(60)

    for pages in (1, 3, 3):
        held["e"] = pages
        run()
        assert sorted(r.page for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect()) == sorted(list(range(1, pages + 1)) * 3)


def test_files_are_pages_too(spark, tmp_path):
    register(spark)
    for page, n in ((1, 2), (2, 1)):
        (tmp_path / f"wsb-{page}.json").write_text(json.dumps([{"ticker": f"T{page}{i}"} for i in range(n)]))
    (tmp_path / "wsb-4.json").write_text("[]")
    assert read(spark, f"file://{tmp_path}/{{topic}}-{{page}}.json", topics="wsb").load().count() == 3
