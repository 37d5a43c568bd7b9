"""Queries of raster operators, on a lattice made of the part table (50 columns)."""

from pyspark.sql import functions as F

from gridloom.functions import keys, physics
from gridloom.operators import raster
from gridloom.plans.domain import table
from gridloom.plans.registry import R, query, rounded

NX = 50
_LATTICE = "lattice AS (SELECT CAST(p_partkey // 50 AS INT) AS iy, CAST(p_partkey % 50 AS INT) AS ix, p_retailprice AS v, p_size FROM part)"


def lattice(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(F.floor(k / NX).cast("int").alias("iy"), (k % NX).cast("int").alias("ix"), F.col("p_retailprice").alias("v"), "p_size")


@query("SELECT k AS cell, CAST(k // 40 AS INT) AS iy, CAST(k % 40 AS INT) AS ix, (k % 40 + 0.5 - 20) * 500.0::DOUBLE AS x, (15 - k // 40 - 0.5) * 500.0::DOUBLE AS y FROM (SELECT unnest(range(0, 1200)) AS k)")
def grid_cells(spark, sf):
    return raster.grid(spark, 30, 500.0, 40)


@query(f"WITH {_LATTICE} SELECT iy, ix, CAST(iy AS BIGINT) * 50 + ix AS cell FROM lattice")
def cell_numbers(spark, sf):
    return lattice(spark, sf).select("iy", "ix", raster.cell_id("iy", "ix", NX).alias("cell"))


@query(f"WITH {_LATTICE}, g AS (SELECT a.iy, a.ix, (coalesce(r.v, a.v) - coalesce(l.v, a.v)) / 1000 AS gx, (coalesce(d.v, a.v) - coalesce(u.v, a.v)) / 1000 AS gy FROM lattice a LEFT JOIN lattice r ON r.iy = a.iy AND r.ix = a.ix + 1 LEFT JOIN lattice l ON l.iy = a.iy AND l.ix = a.ix - 1 LEFT JOIN lattice d ON d.iy = a.iy + 1 AND d.ix = a.ix LEFT JOIN lattice u ON u.iy = a.iy - 1 AND u.ix = a.ix) SELECT iy, ix, {R('sqrt(gx * gx + gy * gy) AS slope')} FROM g")
def grid_slope(spark, sf):
    return rounded(raster.slope(lattice(spark, sf), "v", 500.0), "iy", "ix", "slope")


@query(f"WITH {_LATTICE} SELECT a.iy, a.ix, {R('min(sqrt(pow(a.iy - b.iy, 2) + pow(a.ix - b.ix, 2))) * 500 AS distance')} FROM lattice a LEFT JOIN lattice b ON b.p_size % 17 = 0 GROUP BY 1, 2")
def grid_edt(spark, sf):
    return rounded(raster.distance_to(lattice(spark, sf), F.col("p_size") % 17 == 0, 500.0), "iy", "ix", "distance")



@query(
    f"WITH {_LATTICE}, f AS (SELECT 2 * iy + a AS fy, 2 * ix + b AS fx, (2 * iy + a + 0.5) / 2 - 0.5 AS py, (2 * ix + b + 0.5) / 2 - 0.5 AS px FROM lattice, (SELECT unnest([0, 1]) AS a) , (SELECT unnest([0, 1]) AS b)) "
    "SELECT CAST(fy AS INT) AS iy, CAST(fx AS INT) AS ix, round(sum(l.v * (1 - abs(l.iy - py)) * (1 - abs(l.ix - px))) + 2.5e-10, 8) + 0 AS v FROM f JOIN lattice l ON l.iy IN (floor(py), floor(py) + 1) AND l.ix IN (floor(px), floor(px) + 1) GROUP BY fy, fx HAVING count(*) = 4"
)
def grid_bilinear2x(spark, sf):
    return rounded(raster.bilinear(lattice(spark, sf), "v"), "iy", "ix", "v")


@query(f"WITH {_LATTICE} SELECT CAST(2 * iy + a AS INT) AS iy, CAST(2 * ix + b AS INT) AS ix, p_size FROM lattice, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)")
def grid_nearest(spark, sf):
    return raster.nearest_cells(lattice(spark, sf)).select("iy", "ix", "p_size")


@query("SELECT p_partkey, round(p_retailprice / 7) * 7.0::DOUBLE AS snapped FROM part")
def coord_snap(spark, sf):
    return table(spark, sf, "part").select("p_partkey", keys.snap("p_retailprice", 7.0).alias("snapped"))


@query("WITH p AS (SELECT p_partkey, p_retailprice AS x, p_size * 10.0::DOUBLE AS y FROM part), c AS (SELECT CAST(k AS BIGINT) AS cell, (k % 40 + 0.5) * 50.0::DOUBLE AS x, (k // 40 + 0.5) * 50.0::DOUBLE AS y FROM (SELECT unnest(range(0, 320)) AS k)) SELECT p_partkey, cell FROM p LEFT JOIN c ON round(p.x / 50 - 0.5) = round(c.x / 50 - 0.5) AND round(p.y / 50 - 0.5) = round(c.y / 50 - 0.5) AND abs(p.x - c.x) <= 20 AND abs(p.y - c.y) <= 20")
def nearest_reindex(spark, sf):
    points = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("x"), (F.col("p_size") * 10.0).alias("y"))
    k = F.col("id")
    cells = spark.range(320).select(k.alias("cell"), ((k % 40 + 0.5) * 50.0).alias("x"), ((F.floor(k / 40) + 0.5) * 50.0).alias("y"))
    return raster.reindexed(points, cells, 50.0, 20.0).select("p_partkey", "cell")


@query("SELECT l_partkey, v, s AS sigma, t AS tile FROM (SELECT l_partkey, max(l_extendedprice) AS v, round(max(l_tax) + 2.5e-10, 4) + 0 AS s, CAST(l_suppkey % 4 AS INT) AS t FROM lineitem WHERE l_tax > 0 GROUP BY l_partkey, l_suppkey % 4) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY s, t) = 1")
def mosaic_lowest_sigma(spark, sf):
    rows = table(spark, sf, "lineitem")
    tax = F.max("l_tax")
    tiles = rows.groupBy("l_partkey", (F.col("l_suppkey") % 4).cast("int").alias("tile")).agg(F.max(F.when(F.col("l_tax") > 0, F.col("l_extendedprice"))).alias("v"), F.when(tax > 0, F.round(F.max(F.when(F.col("l_tax") > 0, F.col("l_tax"))) + 2.5e-10, 4)).alias("sigma"))
    return raster.mosaic(tiles, ["l_partkey"], ["v"], "sigma", "tile")


@query("SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM (SELECT round(p_retailprice / 500) * 500.0::DOUBLE AS x, round(p_size / 500.0::DOUBLE) * 500.0::DOUBLE AS y FROM part)")
def tile_canvas(spark, sf):
    return raster.canvas(table(spark, sf, "part").select(F.col("p_retailprice").alias("x"), F.col("p_size").alias("y")), 500.0)


@query("SELECT vec_id, coalesce(max(CASE WHEN e > 0 THEN k END), -1) AS deepest FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(0, len(embedding))) AS k FROM embeddings) GROUP BY 1")
def deepest_valid_level(spark, sf):
    levels = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("level", "e"))
    out = raster.deepest_level(levels.withColumn("e", F.when(F.col("e") > 0, F.col("e"))), ["vec_id"], "e")
    return out.withColumn("deepest", F.col("deepest").cast("long"))


@query(
    "WITH p AS (SELECT vec_id, vec_id % 650 - 5.0::DOUBLE AS t, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings), "
    "k AS (SELECT *, CAST(greatest(1, least(floor(t / 10) + 1, len(e) - 1)) AS INT) AS k FROM p) "
    f"SELECT vec_id, {R('e[k] + least(1, greatest(0, (t - 10 * (k - 1)) / 10)) * (e[k + 1] - e[k]) AS value')} FROM k"
)
def depth_interp(spark, sf):
    profile = F.transform("embedding", lambda e, k: F.struct((k * 10.0).alias("depth"), e.cast("double").alias("value")))
    rows = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 650 - 5.0).alias("target"), profile.alias("profile"))
    return rounded(raster.at_depth(rows), "vec_id", "value")


_POINTS = "SELECT {k} AS {n}, CAST({k} * 37 % 1800 AS DOUBLE) / 20 - 90 AS lat, CAST({k} * 911 % 3600 AS DOUBLE) / 10 - 180 AS lon FROM {t}"


@query(
    f"WITH q AS ({_POINTS.format(k='s_suppkey', n='s_suppkey', t='supplier')}), p AS ({_POINTS.format(k='c_custkey', n='c_custkey', t='customer')}), "
    "d AS (SELECT s_suppkey, c_custkey, 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(p.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - q.lon) / 2), 2)))) AS m FROM q, p) "
    "SELECT s_suppkey, round(min(m), 2) + 0 AS distance FROM d GROUP BY 1"
)
def nearest_haversine(spark, sf):
    at = lambda k: [(F.col(k) * 37 % 1800).cast("double").alias("a"), (F.col(k) * 911 % 3600).cast("double").alias("b")]
    points = lambda t, k: table(spark, sf, t).select(k, *at(k)).select(k, (F.col("a") / 20 - 90).alias("lat"), (F.col("b") / 10 - 180).alias("lon"))
    near = raster.nearest_point(points("supplier", "s_suppkey"), points("customer", "c_custkey"), "s_suppkey", "c_custkey")
    return near.select("s_suppkey", (F.round("distance", 2) + F.lit(0.0)).alias("distance"))


@query("SELECT c_custkey, round(c_custkey * 911 % 3600 / 10.0::DOUBLE - 180, 4) + 0 AS lon, round(-60 - c_custkey * 37 % 290 / 10.0::DOUBLE, 4) + 0 AS lat FROM customer")
def polar_round_trip(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", (k * 911 % 3600 / 10 - 180).alias("lon"), (-60 - k * 37 % 290 / 10).alias("lat"))
    x, y = physics.degrees_to_polar("lat", "lon")
    rows = rows.select("c_custkey", x.alias("x"), y.alias("y"))
    lat, lon = physics.polar_to_degrees("x", "y")
    turn = lambda c: F.round(c, 4) + F.lit(0.0)
    lon = keys.wrap_longitude(turn(lon))
    return rows.select("c_custkey", turn(lon).alias("lon"), turn(lat).alias("lat"))


@query("SELECT c_custkey, (c_custkey * 7 % 720 + 180) % 360 - 180.0::DOUBLE AS lon FROM customer")
def longitude_wrap(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", keys.wrap_longitude((F.col("c_custkey") * 7 % 720).cast("double")).alias("lon"))


@query(f"WITH {_LATTICE} SELECT count(*) FILTER (WHERE p_size > 10 AND v IS NOT NULL) AS v, count(*) FILTER (WHERE p_size > 10) AS n_mask FROM lattice")
def valid_cell_counts(spark, sf):
    return raster.valid_cells(lattice(spark, sf), ["v"], F.col("p_size") > 10)


@query("SELECT CAST(vec_id * 8 + k // 8 AS INT) AS iy, CAST(k % 8 AS INT) AS ix, e AS value FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(0, 64)) AS k FROM embeddings) WHERE e IS NOT NULL AND NOT isnan(e)")
def tile_flatten(spark, sf):
    tiles = table(spark, sf, "embeddings").select((F.col("vec_id") * 8).alias("y0"), F.lit(0).alias("x0"), F.lit(8).alias("width"), F.col("embedding").alias("values"))
    return raster.flattened(tiles)


@query(f"WITH {_LATTICE} SELECT iy, ix, greatest(v - p_size * 40, 0) AS thickness, p_size * 3 - greatest(v - p_size * 40, 0) AS ice_draft, least(abs(p_size * 3 - greatest(v - p_size * 40, 0)), 200) AS clamped_depth FROM lattice")
def draft_and_depth(spark, sf):
    rows = lattice(spark, sf).select("iy", "ix", (F.col("p_size") * 3.0).alias("surface"), (F.col("v") - F.col("p_size") * 40).alias("thickness"), F.lit(200.0).alias("wet"))
    return raster.with_draft(rows, wet="wet").select("iy", "ix", "thickness", "ice_draft", "clamped_depth")


@query(f"WITH {_LATTICE} SELECT iy, ix, CASE WHEN p_size > 10 THEN v ELSE -v END AS v FROM lattice WHERE p_size > 10 OR p_size % 2 = 0")
def land_ocean_merge(spark, sf):
    rows = lattice(spark, sf)
    ocean = rows.where("p_size % 2 = 0").select("iy", "ix", (-F.col("v")).alias("v"))
    return raster.merged_domains(rows.where("p_size > 10"), ocean, ["iy", "ix"], "v")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_retailprice + l_quantity AS raised FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def dynamic_surface(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey")
    rows = raster.raised_by(part, table(spark, sf, "lineitem"), ["l_partkey"], "p_retailprice", "l_quantity", "raised")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "raised")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) IN (6, 7, 8)")
def winter_months(spark, sf):
    return table(spark, sf, "orders").where(keys.in_months("o_orderdate", 1997, (6, 7, 8))).select("o_orderkey", "o_orderdate")


@query("SELECT p_size, p_brand FROM part")
def feature_trimming(spark, sf):
    return keys.trimmed(table(spark, sf, "part"), ["p_size", "missing", "p_brand", "p_size"])[0]


@query("SELECT event_id, CAST(to_timestamp(epoch_ms(ts) // 1000) AT TIME ZONE 'UTC' AS DATE) AS day FROM events")
def epoch_to_date(spark, sf):
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return table(spark, sf, "events").select("event_id", keys.from_epoch_ns(ns).alias("day"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 3)")
def mask_ice(spark, sf):
    return raster.masked(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", (1, 3))


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (2, 3)")
def mask_floating(spark, sf):
    return raster.masked(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", (2, 3))


@query("SELECT c_custkey, lat FROM (SELECT c_custkey, CAST(c_custkey * 37 % 1800 AS DOUBLE) / 20 - 90 AS lat FROM customer) WHERE lat <= -50")
def latitude_crop(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", ((F.col("c_custkey") * 37 % 1800).cast("double") / 20 - 90).alias("lat"))
    return raster.cropped(rows)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_retailprice * 2 AS doubled FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def shared_sources(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_retailprice") * 2).alias("doubled"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return raster.from_shared_source(rows, "l_partkey", lambda keys: keys.join(part, "l_partkey", "left")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "doubled")


@query(
    f"WITH {_LATTICE}, p AS (SELECT c_custkey, c_custkey % 97 * 37.0::DOUBLE / 8 AS x, c_custkey % 89 * 31.0::DOUBLE / 8 AS y FROM customer), f AS (SELECT *, x / 10 - 0.5 AS fx, y / 10 - 0.5 AS fy FROM p), "
    "c AS (SELECT *, floor(fx) AS jx, floor(fy) AS jy, unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b FROM f), w AS (SELECT *, CASE WHEN a = 1 THEN fx - jx ELSE 1 - (fx - jx) END * CASE WHEN b = 1 THEN fy - jy ELSE 1 - (fy - jy) END AS w FROM c) "
    f"SELECT c_custkey, {R('sum(CASE WHEN v IS NOT NULL THEN w * v END) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0) AS v')} FROM w LEFT JOIN lattice ON ix = jx + a AND iy = jy + b GROUP BY 1"
)
def regridded_points(spark, sf):
    k = F.col("c_custkey")
    to = table(spark, sf, "customer").select("c_custkey", ((k % 97) * 37.0 / 8).alias("x"), ((k % 89) * 31.0 / 8).alias("y"))
    return rounded(raster.regridded(lattice(spark, sf), "v", 10.0, to), "c_custkey", "v")


@query("WITH a AS (SELECT DISTINCT round(p_retailprice / 7) * 7.0::DOUBLE + 0 AS x FROM part), g AS (SELECT x, x - lag(x) OVER (ORDER BY x) AS gap FROM a) SELECT count(*) AS n, coalesce(min(gap) > 0, true) AS increasing, count(*) FILTER (WHERE gap <> 7) AS n_gaps FROM g")
def axis_is_monotonic(spark, sf):
    out = raster.axis(table(spark, sf, "part").select(F.col("p_retailprice").alias("x")), "x", 7.0)
    return out.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("gap") > 0, F.lit(True)).alias("increasing"), F.count_if(F.col("gap") != 7).alias("n_gaps"))
