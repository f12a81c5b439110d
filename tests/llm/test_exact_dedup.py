"""Exact dedup: content decides, whatever the digest; nulls, ties, empties and clashing columns."""

from collections import defaultdict

from pyspark.sql import functions as F

from rankloom.llm.exact_dedup import drop_exact_copies, exact_dedup

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "b "), (7, "x" * 200_000), (8, "x" * 200_000), (9, "a"), (10, "A")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((i, max(g), len(g), i == max(g)) for g in groups.values() for i in g)


def run(df, **kw):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df, **kw).collect())


def test_matches_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert run(df) == brute(ROWS)


def test_digest_collisions_are_told_apart_by_content(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert run(df, digest=F.lit("same"), salts=3) == brute(ROWS)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"__id": F.lit(1), "keep_id": F.lit("z"), "__text": F.lit("q")})
    assert run(df) == brute(ROWS)
    assert exact_dedup(df.limit(0)).count() == 0
    kept = drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, _, k in brute(ROWS) if k)


def test_null_and_empty_text_of_one_id_are_one_copy(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (1, "a"), (2, "a")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text or "") for r in drop_exact_copies(df).collect()) == [(1, ""), (2, "a")]
