"""Tables stored in buckets of a key, so that windows, groups and joins by that key start without a shuffle.

A stored table is a folder of Parquet files, bucketed and sorted, with a file ``_layout.json`` that is written last:
key, order, number of buckets, schema, rows, and the bounds of ``fetched_at`` where the table has it. A folder without
that file is what a dead writer has left, and isn't read. Any session reads the folder as a bucketed table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FETCHED = "fetched_at"


@dataclass(frozen=True)
class Layout:
    key: str
    order: list[str]
    buckets: int
    schema: str
    rows: int
    oldest: str | None = None
    newest: str | None = None


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_layout.json")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def layout(spark: SparkSession, path: str) -> Layout | None:
    """What is stored in a folder; None where nothing whole is."""
    fs, target = _file(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return Layout(**json.loads(bytes(stream.readAllBytes())))
    finally:
        stream.close()


def save(df: DataFrame, path: str, key: str = "ticker", order: tuple[str, ...] = ("date",), buckets: int | None = None) -> DataFrame:
    """Write ``df`` in buckets of ``key`` (as many as a shuffle has partitions, unless given) to a new folder, and read it.

    A task writes a bucket, sorted by key and order. Null keys share one bucket; an empty table has a layout and no rows.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if layout(spark, path) is not None:
        raise FileExistsError(path)
    name = f"rankloom_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key, *order).option("path", path).mode("overwrite").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    stored = spark.read.schema(df.schema).parquet(path)
    bounds = [F.min(FETCHED).cast("string"), F.max(FETCHED).cast("string")] if FETCHED in df.columns else [F.lit(None), F.lit(None)]
    rows, oldest, newest = stored.agg(F.count(F.lit(1)), *bounds).first()  # from the files' statistics
    fs, target = _file(spark, path)
    stream = fs.create(target, True)
    stream.write(bytearray(json.dumps(asdict(Layout(key, list(order), buckets, df.schema.json(), rows, oldest, newest))).encode()))
    stream.close()
    return load(spark, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A stored table, with its buckets known to the optimizer."""
    path = path.rstrip("/")
    kind = layout(spark, path)
    if kind is None:
        raise FileNotFoundError(f"{path} holds no whole table")
    name = "rankloom_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(kind.schema)))
        order = ", ".join(f"`{c}`" for c in (kind.key, *kind.order))
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{kind.key}`) SORTED BY ({order}) INTO {kind.buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def fresh(spark: SparkSession, path: str, now: str, ttl_seconds: int) -> bool:
    """Whether all rows of a stored table were fetched within the time to live: told from its layout, without a scan."""
    kind = layout(spark, path)
    if kind is None or kind.oldest is None:
        return False
    return spark.sql("SELECT unix_timestamp(cast(:now AS timestamp)) - unix_timestamp(cast(:then AS timestamp)) <= :ttl", args={"now": now, "then": kind.oldest, "ttl": ttl_seconds}).first()[0]


def stale(spark: SparkSession, path: str, now: str, ttl_seconds: int, key: str = "ticker") -> DataFrame:
    """Keys whose newest row is older than the time to live (those to fetch again). Grouped inside the buckets."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max(FETCHED))
    return load(spark, path).groupBy(key).agg(age.alias("age")).where(F.col("age").isNull() | (F.col("age") > ttl_seconds)).select(key)
