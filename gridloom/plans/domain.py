"""The driver tables read as the engine's own: observations of cells (parts) by month, static
attributes, a sparse ocean series (returned items) and a coarse mass series (orders by nation).
`SQL` builds the same tables as common table expressions, for queries to be held against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.fusion import fuse

#: Months (year * 12 + month) at which training begins and ends, and validation ends, in these tables.
BOUNDS = (23952, 23988, 24000)
#: Boxes over (x, y): two overlap, and some cells lie in none.
BOXES = {"amundsen_sea": (0.0, 9.0, 0.0, 1e9), "antarctic_peninsula": (8.0, 19.0, 0.0, 1e9), "ronne": (20.0, 34.0, 0.0, 1e9), "ross": (35.0, 44.0, 0.0, 1e9)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cell(key: str) -> list:
    return [F.col(key).cast("double").alias("y"), (F.col(key) % 50).cast("double").alias("x")]


def icesat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*cell("l_partkey"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("time"), "l_quantity", "l_extendedprice", "l_discount")
    return rows.groupBy("y", "x", "time").agg(
        F.round(F.avg("l_quantity") - 25, 4).alias("delta_h"), F.round(F.sum("l_extendedprice"), 2).alias("ice_area"), F.round(F.max("l_discount"), 4).alias("surface_slope")
    )


def static(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("p_retailprice"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        *cell("p_partkey"), (F.col("p_partkey") % 25).cast("int").alias("mascon_id"), p.alias("surface"), (s * 20.0 - 500.0).alias("bed"), F.round(p / 2, 4).alias("thickness"),
        F.when(s % 4 == 0, 1).otherwise(3).alias("mask"), ((s % 7) / 10).alias("bed_slope"), (s * 1000.0).alias("dist_to_grounding_line"), (s * 50.0).alias("dist_to_ocean"), (s * -12.5).alias("ice_draft"), F.when(s > 5, s * 10.0).alias("clamped_depth"),
    )
    return rows.withColumn("mascon_id", F.when(F.col("mascon_id") > 0, F.col("mascon_id")))


def ocean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    t, s = F.round(F.col("l_discount") * 30 - 1, 4), F.round(F.col("l_quantity") / 10 + 30, 4)
    return rows.select(*cell("l_partkey"), F.col("l_shipdate").alias("time"), t.alias("thetao"), s.alias("so"), F.round(s * -0.0575 + 0.0901, 6).alias("T_f"), F.round(t - F.round(s * -0.0575 + 0.0901, 6), 6).alias("T_star"))


def grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("c_nationkey").cast("int").alias("mascon_id"), F.col("o_orderdate").alias("time"), F.round(F.col("o_totalprice") / 1000 - 150, 5).alias("lwe_length"))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse(*(f(spark, sf_dir) for f in (icesat, static, ocean, grace)))


_BASE = """
icesat AS (SELECT CAST(l_partkey AS DOUBLE) AS y, CAST(l_partkey % 50 AS DOUBLE) AS x, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS time, round(avg(l_quantity) - 25, 4) AS delta_h,
  round(sum(l_extendedprice), 2) AS ice_area, round(max(l_discount), 4) AS surface_slope FROM lineitem GROUP BY ALL),
static AS (SELECT CAST(p_partkey AS DOUBLE) AS y, CAST(p_partkey % 50 AS DOUBLE) AS x, CASE WHEN p_partkey % 25 > 0 THEN CAST(p_partkey % 25 AS INT) END AS mascon_id, p_retailprice AS surface,
  p_size * 20.0::DOUBLE - 500 AS bed, round(p_retailprice / 2, 4) AS thickness, CASE WHEN p_size % 4 = 0 THEN 1 ELSE 3 END AS mask, (p_size % 7) / 10 AS bed_slope, p_size * 1000.0::DOUBLE AS dist_to_grounding_line,
  p_size * 50.0::DOUBLE AS dist_to_ocean, p_size * -12.5::DOUBLE AS ice_draft, CASE WHEN p_size > 5 THEN p_size * 10.0::DOUBLE END AS clamped_depth FROM part),
ocean AS (SELECT CAST(l_partkey AS DOUBLE) AS y, CAST(l_partkey % 50 AS DOUBLE) AS x, l_shipdate AS time, round(l_discount * 30 - 1, 4) AS thetao, round(l_quantity / 10 + 30, 4) AS so,
  round(round(l_quantity / 10 + 30, 4) * -0.0575::DOUBLE + 0.0901::DOUBLE, 6) AS T_f, round(round(l_discount * 30 - 1, 4) - round(round(l_quantity / 10 + 30, 4) * -0.0575::DOUBLE + 0.0901::DOUBLE, 6), 6) AS T_star
  FROM lineitem WHERE l_returnflag = 'R'),
grace AS (SELECT CAST(c_nationkey AS INT) AS mascon_id, o_orderdate AS time, round(o_totalprice / 1000 - 150, 5) AS lwe_length FROM orders JOIN customer ON o_custkey = c_custkey)"""
_FUSED = """,
ocean_mo AS (SELECT y, x, CAST(year(time) * 12 + month(time) AS INT) AS month_idx, avg(thetao) AS thetao_mo, avg(T_star) AS t_star_mo, avg(so) AS so_mo, avg(T_f) AS t_f_mo FROM ocean GROUP BY ALL),
ocean_f AS (SELECT *, avg(t_star_mo) OVER w AS t_star_quarterly_avg, coalesce(stddev_samp(t_star_mo) OVER w, 0) AS t_star_quarterly_std, avg(thetao_mo) OVER w AS thetao_quarterly_avg,
  coalesce(stddev_samp(thetao_mo) OVER w, 0) AS thetao_quarterly_std FROM ocean_mo WINDOW w AS (PARTITION BY y, x ORDER BY month_idx RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)),
grace_mo AS (SELECT mascon_id, CAST(year(time) * 12 + month(time) AS INT) AS month_idx, max(lwe_length) AS lwe_mo FROM grace WHERE mascon_id IS NOT NULL GROUP BY ALL),
grace_f AS (SELECT *, avg(lwe_mo) OVER w AS lwe_quarterly_avg, coalesce(stddev_samp(lwe_mo) OVER w, 0) AS lwe_quarterly_std
  FROM grace_mo WINDOW w AS (PARTITION BY mascon_id ORDER BY month_idx RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)),
backbone AS (SELECT i.y, i.x, i.time AS exact_time, CAST(year(i.time) * 12 + month(i.time) AS INT) AS month_idx, delta_h, ice_area, surface_slope, s.* EXCLUDE (y, x) FROM icesat i LEFT JOIN static s ON i.y = s.y AND i.x = s.x),
sums AS (SELECT mascon_id, month_idx, count(delta_h) AS n, sum(abs(delta_h)) AS total FROM backbone WHERE mascon_id IS NOT NULL GROUP BY ALL),
fused AS (SELECT b.*, o.* EXCLUDE (y, x, month_idx), g.* EXCLUDE (mascon_id, month_idx),
  CASE WHEN b.mascon_id IS NOT NULL AND delta_h IS NOT NULL AND lwe_mo IS NOT NULL AND coalesce(n, 0) > 0
    THEN CASE WHEN total / n > 1e-4 AND total > 0 THEN abs(delta_h) / total * n * lwe_mo ELSE lwe_mo END END AS lwe_fused
  FROM backbone b LEFT JOIN ocean_f o ON b.y = o.y AND b.x = o.x AND b.month_idx = o.month_idx LEFT JOIN grace_f g ON b.mascon_id = g.mascon_id AND b.month_idx = g.month_idx
  LEFT JOIN sums t ON b.mascon_id = t.mascon_id AND b.month_idx = t.month_idx)"""
_REGION = "CASE " + " ".join(f"WHEN x BETWEEN {a} AND {b} AND y BETWEEN {c} AND {d} THEN '{name}'" for name, (a, b, c, d) in BOXES.items()) + " ELSE 'other' END"
_STORE = f""",
store AS (SELECT * FROM (SELECT *, {_REGION} AS regional_subset_id FROM fused) WHERE regional_subset_id <> 'other'),
stats AS (SELECT regional_subset_id, mascon_id, avg(lwe_quarterly_avg) AS lm, stddev_samp(lwe_quarterly_avg) AS ls FROM store GROUP BY ALL),
heights AS (SELECT regional_subset_id, month_idx, avg(delta_h) AS hm, stddev_samp(delta_h) AS hs FROM store GROUP BY ALL),
labelled AS (SELECT s.*, CAST(coalesce(lwe_quarterly_avg < lm - 0.5 * ls, false) AND coalesce(delta_h < hm - 0.5 * hs, false) AS INT) AS label
  FROM store s LEFT JOIN stats USING (regional_subset_id, mascon_id) LEFT JOIN heights USING (regional_subset_id, month_idx)),
scored AS (SELECT *, ((CAST(y AS BIGINT) * 7919 + CAST(month_idx AS BIGINT) * 104729 + label * 300007) % 1000) / 1000.0::DOUBLE AS score FROM labelled)"""


def base_sql(query: str) -> str:
    return f"WITH {_BASE}\n{query}"


def fused_sql(query: str) -> str:
    return f"WITH {_BASE}{_FUSED}\n{query}"


def store_sql(query: str) -> str:
    return f"WITH {_BASE}{_FUSED}{_STORE}\n{query}"
