"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

from gridloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None else repr(v) if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.fixture(scope="session")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a = sorted([tuple(map(plain, r)) for r in got.select(*(f"`{c}`" for c in want.columns)).collect()], key=str)
    assert a == sorted([tuple(map(plain, r)) for r in want.fetchall()], key=str)


@pytest.mark.parametrize("name", ["pca_variance", "svd_singular_values", "kmeans_sweep"])
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_results_do_not_depend_on_partitions(spark):
    name, seen = "fused_feature_store", set()
    for n in ("1", "2", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(str, QUERIES[name](spark, SF).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:2] == ["y", "x"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
