"""Exact numbering of a whole table without passing it through one task.

Rows are dealt by ranges of the sort keys (equal leading keys are split by the later ones), numbered within a range,
and raised by what the ranges before hold. Only a count a range reaches the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.plans.rel import Rel, written


def numbered(df: DataFrame, *order: Column, name: str = "number") -> tuple[DataFrame, int]:
    """``df`` with a column ``name`` from 1 on in the order of ``order``, and its number of rows.

    The ranges are written once: numbers don't change when a lost task is run again. With keys that tie, equal
    rows are numbered in any order, each once.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()}  # a row a task
    before = dict(zip(sorted(counts), accumulate((counts[k] for k in sorted(counts)), initial=0)))
    bases = ranged.sparkSession.createDataFrame(list(before.items()), "__range int, __before long")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.join(F.broadcast(bases), "__range").withColumn(name, F.col("__before") + own).drop("__range", "__before"), sum(counts.values())


def numbering(name: str, source: Rel, column: str, *order: tuple[str, str]) -> Rel:
    """``source`` with a column of numbers in the order of (expression, ASC or DESC); nulls come last."""
    text = ", ".join(f"{x} {way} NULLS LAST" for x, way in order)
    keys = lambda: [F.expr(x).desc_nulls_last() if way == "DESC" else F.expr(x).asc_nulls_last() for x, way in order]
    return Rel(name, f"SELECT *, row_number() OVER (ORDER BY {text}) AS {column} FROM {source.name}", (source,), run=lambda df: numbered(df, *keys(), name=column)[0])
