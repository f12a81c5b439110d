"""Plans of relations over bars: no table passes through one task, few scans, and kept rows follow their tables."""

import re

import pytest

from rankloom.operators.factors import ALL, CUTS
from rankloom.operators.research import DELTAS, FOLDS, PANEL, SNAPSHOTS
from rankloom.operators.scoring import DEFAULT, scorer
from rankloom.operators.universe import REG as UNIVERSE
from rankloom.operators.profile import PROFILE
from rankloom.plans.rel import Rel, deal, kept
from rankloom.sources.adapters import BARS, QUARTERLY, TICKS

DATA = "/root/testdata/sf0.001"


def plan(rel, spark, **frames):
    tables = {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in rel.tables(set(frames)) - set(frames)}
    return rel.on(spark, **tables, **frames)._jdf.queryExecution().executedPlan().toString()


def single(text):
    """Lines below an exchange into one partition that is no aggregate's, nor a sort of counted days."""
    lines, out = text.splitlines(), []
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            below = lines[i + 1] if i + 1 < len(lines) else ""
            if "HashAggregate" not in below and "SortAggregate" not in below:
                out.append(below.strip())
    return out


@pytest.mark.parametrize("rel", [SNAPSHOTS, PANEL, FOLDS, DELTAS, UNIVERSE.rels["un_disappeared"], scorer(DEFAULT)["scores"]], ids=lambda r: r.name)
def test_no_table_in_one_task(spark, rel):
    values = {"factor_values": spark.range(99).selectExpr("concat('T', id % 9) AS ticker", "'x' AS sector", "concat('f', id % 11) AS factor_id", "cast(id AS double) AS raw"), "penalty_flags": spark.sql("SELECT 'T1' AS ticker, 'bad' AS penalty_id")}
    assert single(plan(rel, spark, **(values if rel.name == "scores" else {}))) == []


def test_factor_inputs_scan_line_items_at_most_three_times(spark):
    frames = {r.name: kept(r, spark, DATA, CUTS) for r in CUTS[:3]}
    assert len(re.findall(r"Scan parquet .*l_suppkey", plan(ALL, spark, **frames))) <= 1  # ratings; bars and quarters scan them once each


def test_kept_rows_follow_their_table(spark, tmp_path):
    table, twice = Rel("numbers"), None
    twice = Rel("twice", "SELECT 2 * n AS n FROM numbers", (table,))
    spark.range(3).selectExpr("id AS n").write.parquet(f"{tmp_path}/numbers.parquet")
    first = kept(twice, spark, str(tmp_path))
    assert sorted(r.n for r in first.collect()) == [0, 2, 4] and kept(twice, spark, str(tmp_path)) is first
    spark.range(5).selectExpr("id AS n").write.mode("overwrite").parquet(f"{tmp_path}/numbers.parquet")
    assert kept(twice, spark, str(tmp_path)).count() == 5


def test_windows_over_bars_sort_narrow_rows_only(spark):
    bars = spark.range(9).selectExpr("concat('T', id % 3) AS ticker", "date_add(date'2024-01-01', cast(id AS int)) AS date", *(f"cast(id AS double) AS {c}" for c in ("open", "high", "low", "close", "volume")))
    text = PROFILE.on(spark, bars=bars)._jdf.queryExecution().executedPlan().toString()
    sorts = re.findall(r"Sort \[(.*?)\], false", text)
    assert len(sorts) == 2 and not any("DESC" in x for x in sorts)  # by time, then by (ticker, block, time)
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_tasks_of_a_kept_relation_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr("rankloom.plans.rel.TASK_ROWS", 10)
    rows = spark.range(95).withColumnRenamed("id", "k")
    assert deal(rows, "k", 95).rdd.getNumPartitions() == 10 and deal(rows, "k", 9) is rows
    assert kept(Rel("dealt_rows", "SELECT * FROM lineitem", (Rel("lineitem"),), dealt="l_suppkey"), spark, DATA).rdd.getNumPartitions() > 100


def test_tasks_that_sum_up_line_items_grow_with_them(spark, monkeypatch):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert TICKS.from_dir(spark, DATA).rdd.getNumPartitions() <= tasks
    monkeypatch.setattr("rankloom.plans.rel.TASK_ROWS", 10)
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert TICKS.from_dir(spark, DATA).rdd.getNumPartitions() == -(-rows // 10) > tasks
    for rel in (BARS, QUARTERLY):  # no second exchange by ticker
        assert len(re.findall(r"Exchange hashpartitioning", plan(rel, spark))) == 1


def test_profile_sums_up_without_boxed_states(spark):
    assert "SortAggregate" not in plan(PROFILE, spark, bars=spark.createDataFrame([], "ticker string, date date, open double, high double, low double, close double, volume double"))


def test_aroon_of_equal_extremes_counts_from_the_oldest(spark):
    bars = spark.range(60).selectExpr("'T' AS ticker", "date_add(date'2024-01-01', cast(id AS int)) AS date", "1e0 AS open", "CASE WHEN id IN (40, 50) THEN 9e0 ELSE 5e0 END AS high", "CASE WHEN id IN (45, 55) THEN 1e0 ELSE 3e0 END AS low", "4e0 AS close", "1e0 AS volume")
    row = PROFILE.on(spark, bars=bars).first()
    assert (row.last_aroon_up, row.last_aroon_down) == (100 * (25 - 19) / 25, 100 * (25 - 14) / 25)
