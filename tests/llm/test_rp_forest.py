"""Vector links against brute force: full recall on small leaves, exact counts, nothing below the threshold."""

import numpy as np

from rankloom.llm.components import Forest
from rankloom.llm.rp_forest import near_vectors, unit


def brute(rows, least=0.9):
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, f = {i: 0 for i, _ in rows}, Forest()
    for d in {len(v) for _, v in good}:
        own = [(i, v) for i, v in good if len(v) == d]
        x = unit(np.array([v for _, v in own]))
        hit = x @ x.T >= least
        for k, (i, _) in enumerate(own):
            n[i] = int(hit[k].sum()) - 1
            for j in np.flatnonzero(hit[k]):
                f.union(i, own[j][0])
    return {i: (n[i], f.find(i)) for i, _ in rows}


def cloud(n, dim, families, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for centre, size, noise in families:
        own = rng.integers(0, n, size)
        x[own] = x[centre] + noise * rng.standard_normal((size, dim))
    return x.astype(np.float32).astype(float)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rep", "2 AS leaf", "3 AS weight").repartition(3)
    return {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, **kw).collect()}


def test_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, []), (9, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [float("inf"), 0.0]), (12, [1e-30, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_with_splits(spark):
    x = cloud(3000, 16, [(0, 40, 0.3), (5, 200, 0.25), (9, 30, 0.5)], 2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = brute(rows), run(spark, rows, leaf=200)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())


def test_large_leaves_are_split_on_and_dense_ones_compared_in_blocks(spark):
    x = cloud(1500, 8, [(3, 500, 0.01)], 4)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = brute(rows), run(spark, rows, leaf=10_000, cap=100, trees=8)  # one leaf at first
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    dense = max(n for n, _ in want.values())
    assert max(n for n, _ in got.values()) == dense


def test_rows_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0]), (4, [-1.0, 0.0]), (4, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (4, 0, 4, True)]


def test_recall_on_all_rows_of_a_table(spark):
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want, got = brute(rows), {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), leaf=64).collect()}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
