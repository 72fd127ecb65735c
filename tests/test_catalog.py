"""Every query of the catalog against its SQL twin."""

import glob
import os

import duckdb
import pytest

from panelwright.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.select(*columns).collect()), key=str)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_partition_count_does_not_matter(spark):
    name = "sample_bottom_k"
    rows = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append([tuple(r) for r in catalog.queries()[name](spark, DATA).collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert rows[0] == rows[1]


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet(f"{DATA}/orders.parquet").where("o_orderkey < 10").select("o_orderdate")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), LessThan(o_orderkey,10)]" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]
