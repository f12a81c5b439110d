"""Shared plumbing of the training-data operators: work tables, size-checked joins, memory of Python workers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20
#: Bytes of a batch of rows on its way to a Python worker, where a session runs several stages over whole texts.
BATCH_BYTES = "4m"

#: What this Python worker keeps from task to task, by kind of work.
_kept: dict[str, dict] = {}


def worker_cache(kind: str) -> dict:
    """What this Python worker keeps from task to task for one kind of work."""
    return _kept.setdefault(kind, {})


def give_back() -> None:
    """Drop what this Python worker keeps and return freed memory to the system: the worker lives on in other stages, and so would its allocators' free pages."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python workers hold BATCH_BYTES in this session from now on, unless it has a bound of its own (Spark's default of 64 MB is held several times over in the JVM and in each worker)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one input table; only Spark opens the path, so any store works."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.select(*columns) if columns else table


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset and the session is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark, "_rankloom_dir", None) or "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark._rankloom_dir = root
    return root.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, if the session still runs."""
    try:
        if spark.sparkContext._jsc is None:
            return
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  at exit the gateway may be gone
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` (counted) of ``row_bytes`` fit the bound, else with none."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def without(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id isn't in ``dropped`` (one materialized column of ids)."""
    return docs.join(sized(dropped, dropped.count(), 64), id_col, "left_anti")


def open_fs(uri: str):
    """pyarrow's file system for a folder, and the folder's path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
