"""Connected components and shared plumbing: hubs, nulls, empty tables, repeated edges, against union-find."""

import random

import pytest

from rankloom.llm.common import sized, without
from rankloom.llm.components import Forest, connected_components


def brute(edges):
    f = Forest()
    for a, b in edges:
        if a is not None and b is not None:
            f.union(a, b)
    nodes = {x for e in edges if None not in e for x in e}
    return {x: f.find(x) for x in nodes if f.find(x) != x}


def run(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long").selectExpr("*", "1 AS m", "2 AS salt").repartition(5)
    rows = connected_components(df).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_with_hubs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)]
    edges += [(5000, i) for i in range(2000, 2600)] + [(i, 1) for i in range(3000, 3400)]  # hubs above and below their neighbours
    edges += [(i, i + 1) for i in range(7000, 7080)] + edges[:50] + [(4, 4)]
    assert run(spark, edges) == brute(edges)


def test_nulls_and_empty(spark):
    assert run(spark, [(None, 1), (2, None), (None, None), (3, 9), (9, 3), (-5, 9)]) == {3: -5, 9: -5}
    assert run(spark, [(None, 1), (3, 3)]) == {}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without_keeps_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    dropped = spark.createDataFrame([(2,), (2,)], "doc_id long")
    assert sorted(r.text for r in without(docs, dropped, "doc_id").collect()) == ["a", "a", "c"]
    assert without(docs, dropped.limit(0), "doc_id").count() == 4
    assert without(docs.limit(0), dropped, "doc_id").count() == 0


def test_sized_hints_only_below_the_bound(spark):
    df = spark.range(3)
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(sized(df, 3, 64)) and "broadcast" not in plan(sized(df, 1 << 30, 64))
