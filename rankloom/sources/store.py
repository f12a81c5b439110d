"""Tables that are refreshed day by day, and published text: upserts, retention, encryption, leak scan."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.plans.numbering import numbered


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """New rows, and old ones whose key isn't among them; columns either side lacks become null."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def merge_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """A day's snapshot run again: new rows win by ticker, then all are ranked anew."""
    merged, kind = upsert(old, new, "ticker").drop("rank"), dict(old.dtypes).get("rank", "bigint")
    return numbered(merged, F.col("total_score").desc_nulls_last(), F.asc("ticker"), name="rank")[0].withColumn("rank", F.col("rank").cast(kind))


def refresh_partitions(spark: SparkSession, rows: DataFrame, path: str, by: str = "date") -> None:
    """Replace the partitions that ``rows`` holds; others stay. Running it twice changes nothing."""
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def retain(history: DataFrame, days: int = 60, by: str = "date") -> DataFrame:
    """The latest ``days`` distinct days."""
    last = history.select(by).distinct().orderBy(F.desc(by)).limit(days)
    return history.join(F.broadcast(last), by, "left_semi")


def update_positions(positions: DataFrame, changes: DataFrame) -> DataFrame:
    """Add or change positions by ticker: fields that a change leaves null keep their value; ``removed`` deletes."""
    fields = [c for c in positions.columns if c != "ticker"]
    p, c = positions.alias("p"), changes.alias("c")
    joined = p.join(c, F.col("p.ticker").eqNullSafe(F.col("c.ticker")), "full").where(~F.coalesce(F.col("c.removed"), F.lit(False)))
    return joined.select(F.coalesce("c.ticker", "p.ticker").alias("ticker"), *[F.coalesce(F.col(f"c.{f}"), F.col(f"p.{f}")).alias(f) for f in fields])


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinities of all numeric columns become null."""
    bad = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if c in bad else F.col(c) for c in df.columns])


def write_ranking(ranking: DataFrame, path: str) -> None:
    """The ranking as CSV files with a header."""
    ranking.orderBy("rank").write.mode("overwrite").option("header", True).csv(path)


ITERATIONS = 600_000


def encrypt(text: DataFrame, password: str, salt: bytes, nonces: str = "nonce", column: str = "text") -> DataFrame:
    """AES-256-GCM of a text column under a PBKDF2-SHA256 key; ``nonces`` is a column of 12 bytes, each used once. Output: nonce, cipher text, tag."""
    key = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ITERATIONS, 32)
    return text.withColumn("blob", F.base64(F.aes_encrypt(F.col(column).cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.col(nonces)))).drop(column, nonces)


def decrypt(blobs: DataFrame, password: str, salt: bytes) -> DataFrame:
    """The texts again; null where the password or the data is wrong."""
    key = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ITERATIONS, 32)
    return blobs.withColumn("text", F.try_aes_decrypt(F.unbase64("blob"), F.lit(key), F.lit("GCM")).cast("string"))


def leaks(pages: DataFrame, required: list[str], forbidden: list[str], column: str = "text") -> DataFrame:
    """Per page: whether all required marks are there, and which forbidden words stand outside quoted blobs of 100 characters or more."""
    bare = F.regexp_replace(column, r'"[A-Za-z0-9+/=]{100,}"', '""')
    found = F.filter(F.array(*[F.when(bare.contains(w), F.lit(w)) for w in forbidden]), lambda w: w.isNotNull())
    return pages.select("*", F.forall(F.array(*[F.lit(w) for w in required]), lambda w: F.contains(F.col(column), w)).alias("complete"), found.alias("leaked"))


#: Fixed value: fewest key derivations of a page that may be published.
LEAST_ITERATIONS = 100_000


def publishable(pages: DataFrame, required: list[str], forbidden: list[str], column: str = "text", least: int = LEAST_ITERATIONS) -> DataFrame:
    """``leaks`` with the number of key derivations that a page states (``"iter": n``; 0 where it states none), and whether it may be published: complete, without leaks, with enough of them. A null page may not."""
    stated = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(column, r'"iter"\s*:\s*(\d{1,18})', 1), F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(0).cast("long"))
    checked = leaks(pages, required, forbidden, column).withColumn("iterations", stated)
    return checked.withColumn("ok", F.coalesce(F.col("complete") & (F.size("leaked") == 0) & (F.col("iterations") >= least), F.lit(False)))


def cached(bars: DataFrame, now: str, ttl_seconds: int, fetched: str = "fetched_at") -> DataFrame:
    """Rows of tickers with at least 30 bars that were fetched within the time to live."""
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    fresh = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(fetched) <= ttl_seconds
    return bars.withColumn("__n", n).where((F.col("__n") >= 30) & fresh).drop("__n")


def cache_key(namespace: str, ident: str) -> str:
    return hashlib.sha1(f"{namespace}:{ident}".encode()).hexdigest()[:20]


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a text file: comments and all after a comma go, upper case, valid ones only."""
    line = F.upper(F.trim(F.split(F.split("value", "#")[0], ",")[0]))
    return spark.read.text(path).select(F.regexp_replace(line, r"\.", "-").alias("symbol")).where(line.rlike(r"^[A-Z][A-Z.\-]{0,6}$")).distinct()


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """Pages of mention counts (JSON with a list ``results``)."""
    schema = "results array<struct<ticker: string, name: string, mentions: long, mentions_24h_ago: long, upvotes: long, rank: int, rank_24h_ago: int>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")


_CELL, _ROW = re.compile(r"<t[dh][^>]*>(.*?)</t[dh]>", re.S | re.I), re.compile(r"<tr[^>]*>(.*?)</tr>", re.S | re.I)


def html_symbols(pages: DataFrame, html: str = "html") -> DataFrame:
    """Of each page's tables the column that looks most like symbols (20 matches and four fifths of its cells, most matches): hash of the page's text, symbol."""
    import pyarrow as pa

    def cells(batches):
        for batch in batches:
            out = []
            for page, text in zip(batch.column("page").to_pylist(), batch.column("html").to_pylist()):
                for t, table in enumerate(re.findall(r"<table[^>]*>(.*?)</table>", text or "", re.S | re.I)):
                    for row in _ROW.findall(table):
                        out += [(page, t, c, re.sub(r"<[^>]+>", "", x).strip()) for c, x in enumerate(_CELL.findall(row))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["page", "t", "c", "cell"])

    # A page is told by a hash of its text, so that the cells and what is counted over them name it alike whenever they are computed.
    found = pages.select(F.xxhash64(html).alias("page"), F.col(html).alias("html")).distinct().mapInArrow(cells, "page long, t long, c long, cell string")
    match = F.col("cell").rlike(r"^[A-Z][A-Z.\-]{0,6}$").cast("int")
    best = found.groupBy("page", "t", "c").agg(F.sum(match).alias("hits"), F.count(F.lit(1)).alias("n")).where("hits >= 20 AND hits >= 0.8 * n")
    first = best.withColumn("r", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("hits"), "t", "c"))).where("r = 1").select("page", "t", "c")
    return found.join(first, ["page", "t", "c"]).where(match == 1).select("page", F.regexp_replace("cell", r"\.", "-").alias("symbol"))


def read_snapshots(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """All snapshots of a store that is partitioned by date (the latest ``last`` of them); columns that a snapshot lacks are null, damaged files are skipped (``skipped_files`` tells which)."""
    rows = spark.read.options(mergeSchema=True, ignoreCorruptFiles=True).parquet(path)
    return rows if last is None else retain(rows, last)


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of a store that give no row: damaged or empty ones, with their lengths."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.parquet").load(path).select("path", "length")
    name = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    read = spark.read.options(mergeSchema=True, ignoreCorruptFiles=True).parquet(path).select(name(F.col("_metadata.file_path")).alias("read")).distinct()
    return files.withColumn("path", name("path")).join(read, F.col("path") == F.col("read"), "left_anti")


def read_cache(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Cached JSON records: the sound ones, and the text of those that are no record of the schema."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("record"), F.from_json("value", f"{schema}, _corrupt string", options).alias("r"))
    return rows.where("r is not null and r._corrupt is null").select("r.*").drop("_corrupt"), rows.where("r is null or r._corrupt is not null").select("record")


def last_ranking(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot of a store, in rank order."""
    return read_snapshots(spark, path, 1).orderBy("rank")


def read_sentiment(spark: SparkSession, path: str) -> DataFrame:
    """Sentiment records (a JSON list of ticker, no_of_comments, sentiment and sentiment_score), symbols in upper case, the record of most comments each."""
    schema = "ticker string, no_of_comments long, sentiment string, sentiment_score double"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).where("ticker is not null").withColumn("ticker", F.upper("ticker"))
    best = F.struct(F.coalesce("no_of_comments", F.lit(0)), "sentiment", "sentiment_score")
    return rows.groupBy("ticker").agg(F.max_by(F.struct("no_of_comments", "sentiment", "sentiment_score"), best).alias("r")).select("ticker", "r.*")


def watchlist(positions: DataFrame, universe: DataFrame) -> DataFrame:
    """The universe with every watched ticker in it: watched ones are pinned and come first."""
    own = positions.select("ticker").where("ticker is not null").distinct()
    rest = universe.join(own, "ticker", "left_anti").withColumn("pinned", F.lit(False))
    return own.withColumn("pinned", F.lit(True)).unionByName(rest, allowMissingColumns=True)


def position_history(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Each position's bars since it was added, with the gain since entry in percent."""
    p, b = positions.select("ticker", "added_date", "entry_price"), bars.select("ticker", "date", "close")
    held = b.join(p, "ticker").where("date >= added_date")
    return held.withColumn("pnl_pct", 100 * (F.col("close") / F.nullif("entry_price", F.lit(0.0)) - 1))


def record_scans(log: DataFrame, scanned: DataFrame, day: str) -> DataFrame:
    """The scan log (ticker, last_scan) after a day's scan: a full outer merge in which a later day wins."""
    today = scanned.select(F.upper("ticker").alias("ticker")).where("ticker is not null").distinct().withColumn("day", F.lit(day))
    joined = log.groupBy("ticker").agg(F.max("last_scan").alias("last_scan")).join(today, "ticker", "full")
    return joined.select("ticker", F.greatest("last_scan", "day").alias("last_scan"))


def should_cache(bars: DataFrame, least: int = 30) -> DataFrame:
    """Tickers whose answer is worth keeping: ``least`` bars with a close."""
    return bars.where("close is not null").groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("ticker")


def purge(cache: DataFrame, now: str, ttl_seconds: int, fetched: str = "fetched_at", namespace: str | None = None, content: str | None = None, least: int = 0) -> DataFrame:
    """What stays of a cache: entries within the time to live; with ``namespace`` all of that namespace go as well, with ``content`` those whose content is null or (text or a list) shorter than ``least``."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(fetched)
    kept = cache.where(age <= ttl_seconds)
    if content is not None:
        long = F.length(content) if dict(cache.dtypes)[content] in ("string", "binary") else F.size(content)
        kept = kept.where(F.col(content).isNotNull() & (long >= least))
    return kept if namespace is None else kept.where(~F.col("namespace").eqNullSafe(F.lit(namespace)))


def run_status(ranking: DataFrame, universe: DataFrame, scanned: DataFrame, dropped: DataFrame) -> DataFrame:
    """One row on a run: ranked, universe, scanned and dropped tickers, and whether anything was ranked."""
    counts = [d.agg(F.count(F.lit(1)).alias(n)) for d, n in ((ranking, "ranked"), (universe, "universe"), (scanned, "scanned"), (dropped, "dropped"))]
    out = counts[0]
    for c in counts[1:]:  # one row each
        out = out.join(F.broadcast(c))
    return out.withColumn("ok", F.col("ranked") > 0).withColumn("scanned_pct", F.round(100 * F.col("scanned") / F.greatest(F.lit(1), F.col("universe")), 1))
