"""Queries of scans and sinks: what is written to the shared folder must be read again as it was."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.plans.domain import table
from gridloom.plans.registry import query
from gridloom.sources import tables

_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS month_idx FROM orders"


def _orders(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (F.year(d) * 12 + F.month(d)).cast("int").alias("month_idx"))


def _folder(spark) -> str:
    return f"{tables.shared_folder(spark)}/queries-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _path(sf: str, name: str) -> str:
    return f"{sf}/{name}.parquet"


@query("SELECT * FROM nation")
def scan_file(spark, sf):
    return tables.scan(spark, _path(sf, "nation"))


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def sql_over_views(spark, sf):
    tables.views(spark, {f"scan_{t}": _path(sf, t) for t in ("nation", "region")})
    return spark.sql("SELECT r_name, count(*) AS n FROM scan_nation JOIN scan_region ON n_regionkey = r_regionkey GROUP BY r_name")


@query(f"SELECT month_idx, count(*) AS n, min(o_orderkey) AS first FROM ({_ORDERS}) GROUP BY 1")
def hive_partitions(spark, sf):
    path = _folder(spark)
    tables.save(_orders(spark, sf), path, by=["month_idx"])
    return tables.scan(spark, path).groupBy("month_idx").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query("SELECT n_nationkey AS k, n_name AS name, NULL::DOUBLE AS price FROM nation UNION ALL SELECT CAST(p_partkey AS INT), NULL, p_retailprice FROM part")
def merged_schemas(spark, sf):
    path = _folder(spark)
    tables.save(table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_name").alias("name")), f"{path}/a")
    tables.save(table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("k"), F.col("p_retailprice").alias("price")), f"{path}/b")
    return tables.scan(spark, path, merge=True, recursive=True).select("k", "name", "price")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def recursive_scan(spark, sf):
    path = _folder(spark)
    tables.save(_orders(spark, sf), f"{path}/deep/er", by=["month_idx"])
    return tables.scan(spark, path, recursive=True)


@query("SELECT c_custkey, c_name, NULL::INT AS c_absent FROM customer")
def explicit_schema(spark, sf):
    return tables.scan(spark, _path(sf, "customer"), schema="c_custkey long, c_name string, c_absent int")


@query("SELECT r_regionkey AS k, r_name AS name, 'region' AS kind FROM region UNION ALL SELECT n_nationkey, n_name, 'nation' FROM nation")
def tagged_files(spark, sf):
    path = _folder(spark)
    tables.save(table(spark, sf, "region").toDF("k", "name"), f"{path}/region")
    tables.save(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), f"{path}/nation")
    return tables.scan_tagged(spark, {k: f"{path}/{k}" for k in ("region", "nation")}, "kind")


@query("SELECT CASE WHEN x BETWEEN 0 AND 9 THEN 'low' ELSE 'high' END AS regional_subset_id, count(*) AS n FROM (SELECT p_partkey % 50 AS x FROM part) WHERE x BETWEEN 0 AND 30 GROUP BY 1")
def observations_by_mode(spark, sf):
    path, boxes = _folder(spark), {"low": (0.0, 9.0, 0.0, 1e9), "high": (10.0, 30.0, 0.0, 1e9)}
    tables.save(table(spark, sf, "part").select((F.col("p_partkey") % 50).cast("double").alias("x"), F.col("p_partkey").cast("double").alias("y")), path)
    return tables.observations(spark, "full", path, regions=boxes).groupBy("regional_subset_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'month_idx=' || month_idx AS partition FROM ({_ORDERS}) GROUP BY 1")
def file_census(spark, sf):
    path = _folder(spark)
    tables.save(_orders(spark, sf), path, by=["month_idx"])
    return tables.census(spark, path).where("n_files > 0 and bytes > 0").select("partition")


@query("SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS \"column\", unnest(['int', 'string', 'int']) AS type")
def footer_schema(spark, sf):
    return tables.schema_rows(spark, _path(sf, "nation"))


@query("SELECT 1 AS n_with, 1 AS n_without")
def discovered_files(spark, sf):
    path = _folder(spark)
    tables.save(table(spark, sf, "region").coalesce(1), f"{path}/full")
    found, without = tables.discover(spark, [f"{path}/full", f"{path}/none"])
    return spark.createDataFrame([(len(found), len(without))], "n_with int, n_without int")


@query("SELECT count(*) AS n, 0 AS n_out_of_order FROM orders")
def sorted_sink(spark, sf):
    """Rows of a file are in order, and files do not overlap."""
    path = _folder(spark)
    tables.save_sorted(_orders(spark, sf), path, ["o_custkey", "o_orderkey"])
    rows = tables.scan(spark, path).select(F.input_file_name().alias("f"), F.struct("o_custkey", "o_orderkey").alias("k"))
    files = rows.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    w = Window.orderBy("lo")
    files = files.withColumn("bad", (F.lag("hi").over(w) > F.col("lo")).cast("int"))
    return files.agg(F.sum("n").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("int").alias("n_out_of_order"))


@query(f"SELECT o_orderkey, o_custkey, o_totalprice, CAST(month_idx AS VARCHAR) AS month_idx FROM ({_ORDERS}) WHERE month_idx = 23950")
def one_partition(spark, sf):
    path = _folder(spark)
    tables.save(_orders(spark, sf), path, by=["month_idx"])
    return tables.partition_of(spark, path, "month_idx", "23950")


@query("SELECT count(*) AS n, true AS resumed FROM orders")
def resumed_stage(spark, sf):
    """A finished stage is taken as it is."""
    path = _folder(spark)
    rows = tables.stage(_orders(spark, sf), path)
    again = tables.stage(rows.limit(0), path, resume=True)
    return again.agg(F.count(F.lit(1)).alias("n")).withColumn("resumed", F.lit(tables.exists(spark, path)))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def checkpointed_counts(spark, sf):
    return tables.checkpointed(_orders(spark, sf).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT count(*) AS n, sum(o_orderkey) AS s FROM orders")
def kept_on_disk_totals(spark, sf):
    with tables.kept_on_disk(_orders(spark, sf)) as rows:
        n, s = rows.count(), rows.agg(F.sum("o_orderkey")).first()[0]
    return spark.createDataFrame([(n, s)], "n long, s long")


@query(f"SELECT month_idx, CASE WHEN month_idx = 23950 THEN 1 ELSE count(*) END AS n FROM ({_ORDERS}) GROUP BY 1")
def overwritten_partition(spark, sf):
    """Only the partitions written to are replaced."""
    path = _folder(spark)
    tables.save(_orders(spark, sf), path, by=["month_idx"])
    with _setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        tables.save(spark.createDataFrame([(0, 0, 0.0, 23950)], "o_orderkey long, o_custkey long, o_totalprice double, month_idx int"), path, by=["month_idx"])
    return tables.scan(spark, path).groupBy("month_idx").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT true AS one_file, true AS near_size")
def saved_sample(spark, sf):
    path = _folder(spark)
    orders = _orders(spark, sf)
    tables.save_sample(orders, path, 200, ["o_orderkey"])
    found, _ = tables.discover(spark, [path])
    rows = tables.scan(spark, path).count()
    return spark.createDataFrame([(len(found) == 1, 120 <= rows <= 400)], "one_file boolean, near_size boolean")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 50")
def saved_first(spark, sf):
    path = _folder(spark)
    tables.save_first(_orders(spark, sf), path, ["o_orderkey", "o_custkey", "o_absent"], ["o_custkey", "o_orderkey"], 50)
    return tables.scan(spark, path)


@contextmanager
def _setting(spark, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
