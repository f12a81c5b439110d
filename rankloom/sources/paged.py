"""Paged JSON sources as a Spark data source: ``spark.read.format("pages")`` and ``spark.readStream.format("pages")``.

A page is a JSON document with a list ``results`` and, if the service says so, the number of ``pages``. Pages of a
topic are dealt to partitions by the number that its first page tells (without one, a task reads on until an empty
page). A request is tried again after a growing pause; one that is refused for its rate isn't, and a topic whose page
can't be had ends there or fails the read, as asked.

Options: ``url`` (a template with {topic} and {page}), ``topics`` (separated by commas), ``max_pages``, ``pages_per_task``,
``attempts``, ``backoff`` (seconds before the second attempt, doubled before each further one), ``timeout``, ``on_error``
(stop or fail). The fields of the schema that is asked for are taken from the results, by name; ``topic`` and ``page``
tell where a row comes from. A test of equality on ``topic`` leaves the other topics unread.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

SCHEMA = "topic string, page int, ticker string, name string, mentions long, mentions_24h_ago long, upvotes long, rank int, rank_24h_ago int"


class RateLimited(RuntimeError):
    """The service slows us down on purpose: asking again only prolongs it."""


class PageFailed(RuntimeError):
    """A page that no attempt could get."""


@dataclass
class Fetch:
    """How pages are asked for."""

    url: str
    attempts: int = 3
    backoff: float = 1.5
    timeout: float = 25.0

    def page(self, topic: str, page: int) -> dict | None:
        """A page's document; None where there is no such page."""
        url = self.url.replace("{topic}", topic).replace("{page}", str(page))
        for turn in range(self.attempts):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=self.timeout) as answer:
                    document = json.load(answer)
                    return document if isinstance(document, dict) else {"results": document}
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if e.code == 429:
                    raise RateLimited(f"{url}: {e}") from e
                failed = e
            except FileNotFoundError:
                return None
            except (OSError, ValueError) as e:  # the connection, or a page that is no JSON
                if isinstance(getattr(e, "reason", None), FileNotFoundError) or "No such file" in str(e):
                    return None
                failed = e
            if turn < self.attempts - 1:
                time.sleep(self.backoff * 2**turn * (1 + random.random()))
        raise PageFailed(f"{url}: {failed}")


@dataclass
class Pages(InputPartition):
    """Pages of a topic from ``first`` on, before ``end`` (None: until an empty one)."""

    topic: str
    first: int
    end: int | None

    def __init__(self, topic: str, first: int, end: int | None):
        super().__init__((topic, first, end))
        self.topic, self.first, self.end = topic, first, end


def _cast(value, kind):
    """A field as its column's type; what doesn't fit is null."""
    if value is None or value == "":
        return None
    try:
        if isinstance(kind, (IntegerType, LongType)):
            return int(float(value)) if isinstance(value, str) else int(value)
        if isinstance(kind, (DoubleType, FloatType)):
            return float(str(value).replace(",", ""))
        if isinstance(kind, BooleanType):
            return bool(value)
        return str(value) if isinstance(kind, StringType) else value
    except (TypeError, ValueError):
        return None


class _Reading:
    """What batch and streaming readers share."""

    def __init__(self, options: dict, schema: StructType):
        self.fetch = Fetch(options["url"], int(options.get("attempts", 3)), float(options.get("backoff", 1.5)), float(options.get("timeout", 25)))
        self.topics = [t.strip() for t in options.get("topics", "all").split(",") if t.strip()]
        self.max_pages, self.per_task = int(options.get("max_pages", 10_000)), int(options.get("pages_per_task", 8))
        self.fails = options.get("on_error", "stop") == "fail"
        self.schema = schema

    def document(self, topic: str, page: int) -> dict | None:
        try:
            return self.fetch.page(topic, page)
        except (RateLimited, PageFailed):
            if self.fails:
                raise
            return None

    def rows(self, topic: str, page: int, document: dict) -> Iterator[tuple]:
        for r in document.get("results") or []:
            yield tuple(_cast({"topic": topic, "page": page}.get(f.name, r.get(f.name)), f.dataType) for f in self.schema)


class PagesReader(_Reading, DataSourceReader):
    def pushFilters(self, filters):
        """Topics that a filter excludes aren't read; Spark still applies every filter."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("topic",):
                self.topics = [t for t in self.topics if t == f.value]
            yield f

    def partitions(self) -> list[Pages]:
        out = []
        for topic in self.topics:
            first = self.document(topic, 1)
            if not first or not first.get("results"):
                continue
            told = first.get("pages")
            if told is None:
                out.append(Pages(topic, 1, None))
            else:
                end = min(int(told), self.max_pages) + 1
                out += [Pages(topic, k, min(k + self.per_task, end)) for k in range(1, end, self.per_task)]
        return out or [Pages("", 1, 1)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        page = partition.first
        while page < (self.max_pages + 1 if partition.end is None else partition.end):
            document = self.document(partition.topic, page)
            if not document or not document.get("results"):
                return
            yield from self.rows(partition.topic, page, document)
            page += 1


class PagesStream(_Reading, SimpleDataSourceStreamReader):
    """Offsets are the next page of each topic; a batch takes the pages that have come since."""

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.topics, 1)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for topic in self.topics:
            page = end.setdefault(topic, 1)
            while page <= self.max_pages and (document := self.document(topic, page)) and document.get("results"):
                rows += self.rows(topic, page, document)
                page += 1
            end[topic] = page
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for topic, last in end.items():
            for page in range(start.get(topic, 1), last):
                document = self.fetch.page(topic, page)  # a batch that is run again must be whole
                if document is None:
                    raise PageFailed(f"{topic}: page {page} is gone")
                yield from self.rows(topic, page, document)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(self.options, schema)

    def simpleStreamReader(self, schema: StructType) -> PagesStream:
        return PagesStream(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make ``format("pages")`` known to the session."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
