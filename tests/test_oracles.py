"""Every registered relation gives the same rows on Spark as its SQL in DuckDB."""

import datetime
import math

import duckdb
import pytest

from rankloom.operators.research import FEATURES, REG
from rankloom.plans import registry
from rankloom.plans.rel import Duck, Spark

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4) + 0.0
    return str(x) if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(x) for x in r) for r in got.select(*columns).collect()), key=repr)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert rows == sorted((tuple(plain(x) for x in r) for r in want), key=repr)


def test_ties_are_rounded_as_the_sql_rounds_them(spark):
    """Shares of whole volumes end at the sixth digit: 0.071875 times 1e5 lies below a half in binary."""
    query, values = REG.rels["ml_constant_features"], [0.071875, 0.07187, -0.071875, 0.503125, 0.50313, 0.128125, 0.12813, -0.000001, 0.0, 1.015625, 1e300, None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").selectExpr(*[f"x AS {f}" for f in FEATURES])
    con = duckdb.connect()
    con.sql("CREATE TABLE snapshots AS SELECT " + ", ".join(f"x AS {f}" for f in FEATURES) + " FROM (SELECT unnest(?::double[]) AS x) t", params=[values])
    assert tuple(query.on(spark, snapshots=rows).first()) == con.sql(query.text(Duck)).fetchall()[0]
    shown = rows.selectExpr(f"{Spark.binary_round(FEATURES[0], 5)} AS x").collect()
    assert [r.x for r in shown] == [r[0] for r in con.sql(f"SELECT round({FEATURES[0]}, 5) FROM snapshots").fetchall()]
