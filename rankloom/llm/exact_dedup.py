"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Rows are deduplicated inside each map task (the partial aggregate), then per (digest, salt) group, then
the salt winners per digest. Every grouping key holds the full text beside its digest, so two texts are
merged only if all their bytes are equal. A text copied a billion times sends at most one row per map
task and salt to a reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import materialize, sized

#: Salted groups a digest is dealt into.
SALTS = 128


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None, salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    A null text counts as the empty one. Of equal texts the row with the largest id stays; rows that
    repeat both id and text are all marked kept if the id is. Null ids never win against others and a
    group of nulls only has a null keep_id. Other columns of ``docs`` are not read. An empty table gives
    an empty result. ``digest`` replaces SHA-256 as grouping digest (a weak one shows that collisions
    are told apart by content).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    rows = docs.select(
        F.col(id_col).alias("__id"),
        text.alias("__text"),
        (sha if digest is None else digest).alias("__digest"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("__salt"),
    )
    salted = rows.groupBy("__digest", "__salt", "__text").agg(F.max("__id").alias("__winner"), F.count(F.lit(1)).alias("__n"))
    merged = salted.groupBy("__digest", "__text").agg(F.max("__winner").alias("__keep"), F.sum("__n").alias("__size"))
    final = merged.groupBy("__digest").agg(F.count(F.lit(1)).alias("__texts"), F.max("__keep").alias("__keep"), F.max("__size").alias("__size"))
    # A digest with a single text is settled: its members are known by digest and salt, and texts needn't move again.
    cells = salted.groupBy("__digest", "__salt").agg(F.sum("__n").alias("__cell"))
    classes = materialize(cells.join(final, "__digest").drop("__cell"), "exact-classes")
    slim = rows.drop("__text") if digest is None else rows
    settled = slim.join(classes.where("__texts = 1").drop("__texts"), ["__digest", "__salt"])
    out = settled.select("__id", "__keep", "__size", (F.col("__digest") if digest is None else F.sha2(F.col("__text").cast("binary"), 256)).alias("__sha"))
    if not classes.where("__texts > 1").isEmpty():
        collided = classes.where("__texts > 1").select("__digest").distinct()
        clashing = rows.join(collided, "__digest", "left_semi")
        owners = merged.join(collided, "__digest", "left_semi")
        out = out.unionByName(clashing.join(owners, ["__digest", "__text"]).select("__id", "__keep", "__size", F.sha2(F.col("__text").cast("binary"), 256).alias("__sha")))
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, that of the largest id; all columns stay as they are. Of rows that repeat both id and text (a null text is an empty one) one stays."""
    groups = materialize(exact_dedup(docs, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"), "kept"), "exact-groups")
    dropped = groups.where("not kept").select("__id", "__sha")
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)
    same = docs[id_col].eqNullSafe(dropped["__id"]) & (sha == dropped["__sha"])
    out = docs.join(sized(dropped, dropped.count(), 128), same, "left_anti")
    repeated = groups.where("kept").groupBy("__id", "__sha").count().where("count > 1")
    if repeated.isEmpty():
        return out
    return out.withColumn("__copied_text", F.coalesce(F.col(text_col), F.lit(""))).dropDuplicates([id_col, "__copied_text"]).drop("__copied_text")
