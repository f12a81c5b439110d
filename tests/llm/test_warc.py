"""WARC bundles: round trips, revisits against brute force, random access, ids that hold page ids."""

import base64
import hashlib
from collections import defaultdict

import pytest
import zstandard
from hypothesis import given
from hypothesis import strategies as st

from rankloom.llm.common import open_fs, work_dir
from rankloom.llm.warc import BundleReader, archive_pages, base32_sha1, fetch_records, page_of, read_archives, record_id, write_archives

HTML = [(1, "u1", "<p>é</p>"), (2, "u2", "<p>é</p>"), (3, None, None), (4, "a\r\nb", ""), (5, "u5", "x\r\n\r\ny"), (6, "u6", "z" * 700_000), (7, "u7", "<p>é</p>"), (8, "u8", "WARC/1.1\r\n\r\n")]


def brute(rows, least=0):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and len(data) >= least and i != max(x for x in groups[h or ""] if x is not None)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", max(x for x in groups[h or ""] if x is not None) if again else None))
    return sorted(out, key=str)


@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.text())
def test_record_ids_hold_page_ids(page, text):
    assert page_of(record_id(page, base32_sha1(text.encode()))) == page


@pytest.mark.parametrize("rows", [HTML, [*HTML, (7, "u7", "<p>é</p>"), (2, "other", "different"), (None, "n", "<p>é</p>")]])
@pytest.mark.parametrize("least", [0, 1])
def test_round_trip(spark, rows, least):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS n", "3 AS refers_to").repartition(3)
    assert sorted(map(tuple, archive_pages(df, least).collect()), key=str) == brute(rows, least)


def test_empty(spark):
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_random_access_and_plain_decompression(spark):
    df = spark.createDataFrame(HTML * 1, "page_id long, url string, html string").coalesce(1)
    folder = work_dir(spark, "warc-test")
    index = write_archives(df, folder)
    got = {page_of(r.record_id): bytes(r.record) for r in fetch_records(index, folder, index.where("page_id in (5, 6)")).collect()}
    assert got[5].endswith(b"x\r\n\r\ny\r\n\r\n") and b"z" * 700_000 in got[6] and len(got) == 2
    fs, root = open_fs(folder)
    (name,) = {r.file for r in index.collect()}
    data = fs.open_input_file(f"{root}/{name}").read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC-Record-ID") == len(HTML)
    with fs.open_input_file(f"{root}/{name}") as source:
        assert len(BundleReader(source).frames) > 1
    assert read_archives(index, folder).count() == len(HTML)
