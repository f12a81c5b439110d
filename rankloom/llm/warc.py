"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a skippable frame at the end is the seek table of the public
seekable format (sizes of every frame). An index table maps record ids to file, frame and the offset
within the frame's content, so one record costs one ranged read and one frame's decompression. Every task
writes one bundle under a name of its own attempt and reports it; readers open only reported bundles.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import materialize, open_fs, sized, work_dir

#: Fixed values of the seekable format: skippable frame's and footer's magic numbers.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value of WARC 1.1: profile of a revisit whose payload is the same.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Content bytes after which a frame is closed.
FRAME_BYTES = 1 << 18
SALTS = 64
INDEX = "file string, frame int, offset int, length int, record_id string, page_id long, n_bytes long"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """A version 8 UUID that holds the page id (or that there is none) and 57 bits of the payload's digest."""
    page = (page_id or 0) & (1 << 64) - 1
    low = int.from_bytes(hashlib.sha1(digest.encode()).digest()[:8], "big") >> 7 | (page_id is None) << 57
    return f"urn:uuid:{uuid.UUID(int=page >> 16 << 80 | 8 << 76 | (page >> 4 & 0xFFF) << 64 | 2 << 62 | (page & 15) << 58 | low)}"


def page_of(record: str) -> int | None:
    """The page id that a record id holds."""
    x = uuid.UUID(record.removeprefix("urn:uuid:")).int
    page = x >> 80 << 16 | (x >> 64 & 0xFFF) << 4 | x >> 58 & 15
    return None if x >> 57 & 1 else page - (1 << 64) * (page >> 63)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> tuple[str, bytes]:
    """(record id, bytes) of a response, or of a revisit that names the response's record."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    own = record_id(page_id, digest)
    target = "".join(" " if c.isspace() else c for c in url or "")  # a header is one line
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{own}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        *([f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return own, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and the offset after it."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    head = dict(line.split(": ", 1) for line in lines)
    begin, n = end + 4, int(head["Content-Length"])
    return head, data[begin : begin + n], begin + n + 4


class BundleWriter:
    """Streams records into frames; holds one frame's content and 8 bytes a frame."""

    def __init__(self, sink, level: int = 3):
        import zstandard

        self.sink, self.compressor = sink, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.content, self.size, self.total = [], [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset that the record gets."""
        if self.size and self.size + len(data) > FRAME_BYTES:
            self._flush()
        at = len(self.frames), self.size
        self.content.append(data)
        self.size += len(data)
        return at

    def _flush(self) -> None:
        if self.content:
            packed = self.compressor.compress(b"".join(self.content))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.total += len(packed)
            self.content, self.size = [], 0

    def close(self) -> int:
        """Writes the last frame and the seek table; returns the bundle's bytes."""
        self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        return self.total + 8 + len(table)


class BundleReader:
    """Frames of a bundle by number, found through its seek table."""

    def __init__(self, source):
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        table = self._at(size - 9 - n * width, n * width)
        self.frames, at = [], 0
        for i in range(n):
            packed, content = struct.unpack_from("<II", table, i * width)
            self.frames.append((at, packed, content))
            at += packed

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, i: int) -> bytes:
        at, packed, content = self.frames[i]
        return self.decompressor.decompress(self._at(at, packed), max_output_size=content)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for i in range(len(self.frames)):
            data, at = self.frame(i), 0
            while at < len(data):
                head, block, at = parse(data, at)
                yield head, block


def describe(head: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A record as (page_id, payload_bytes, payload_digest, record_type, refers_to); a response's payload is checked against its digest."""
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    if kind == "response" and (len(payload), base32_sha1(payload)) != (length, digest):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    return page_of(head["WARC-Record-ID"].strip("<>")), length, digest, kind, page_of(head["WARC-Refers-To"].strip("<>")) if kind == "revisit" else None


def revisits(pages: DataFrame, min_bytes: int, id_col: str, html_col: str) -> DataFrame:
    """(page_id, key, refers_to) of the rows whose payload another page with a larger id holds, key its digest; combined like exact dedup."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(payload, 256).alias("key"), F.length(payload).alias("n"), F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias("salt"))
    rows = rows.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull())
    cells = rows.groupBy("key", "n", "salt").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("rows"))
    owners = cells.groupBy("key", "n").agg(F.max("top").alias("refers_to"), F.sum("rows").alias("rows")).where("rows > 1")
    known = cells.select("key", "n", "salt").join(owners.select("key", "n", "refers_to"), ["key", "n"])
    return rows.join(known, ["key", "n", "salt"]).where("page_id <> refers_to").select("page_id", "key", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page into bundles in ``folder``; returns the index (one row per record, n_bytes set on a bundle's last), which is kept beside them as Parquet in ``folder``/index.

    Null html is an empty payload, a null url an empty target. Of equal payloads of at least ``min_bytes``
    the page with the largest id is a response and the others revisit it; rows that repeat that id are
    responses too, and share their record id with those of the same id and payload (the index lists each). Rows with a null id are responses. An empty table writes nothing. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    # A row is told by its id and, as ids may repeat, its payload's digest; the payloads don't move where the revisits fit a broadcast.
    again = materialize(revisits(pages, min_bytes, id_col, html_col), "revisits")
    rows = rows.withColumn("key", F.sha2(F.col("html").cast("binary"), 256)).join(sized(again, again.count(), 160), ["page_id", "key"], "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        name, sink = f"bundle-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst", None
        names = ["file", "frame", "offset", "length", "record_id", "page_id", "n_bytes"]
        held: list[tuple] = []

        def rows_of(x):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*x), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=names)

        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer = BundleWriter(sink)
                for page_id, url, html, refers_to in zip(*[part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")]):
                    own, data = record(page_id, url, html.encode(), refers_to, refers_to is not None, date)
                    held.append((name, *writer.add(data), len(data), own, page_id, None))
                if len(held) > 4096:
                    yield rows_of(held[:-1])
                    held = held[-1:]
        if sink is not None:
            n = writer.close()
            sink.close()
            held[-1] = (*held[-1][:-1], n)
            yield rows_of(held)

    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the indexed bundles: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = index.select("file").distinct()
    n = index.where("n_bytes is not null").count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_file(f"{root}/{name}") as source:
                    rows = []
                    for head, block in BundleReader(source).records():
                        rows.append(describe(head, block))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return files.repartition(max(1, min(n, 4096))).mapInArrow(read, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def fetch_records(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """The whole records (record_id, record) whose record_id is in ``wanted``: one ranged read and one frame each."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}") as source:
                    data = BundleReader(source).frame(row["frame"])[row["offset"] : row["offset"] + row["length"]]
                yield pa.RecordBatch.from_pydict({"record_id": [row["record_id"]], "record": [data]})

    return index.join(wanted.select("record_id").distinct(), "record_id", "left_semi").mapInArrow(fetch, "record_id string, record binary")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages into bundles in the shared folder and read the bundles back."""
    folder = work_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes), folder)
