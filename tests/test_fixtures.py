"""Hand-computed cases of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import keys, physics
from gridloom.operators import evaluation, fusion, ml, profile, quality, raster, sampling
from gridloom.operators.windows import Series
from gridloom.plans import features
from gridloom.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def column(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(("day", "index"), [("2020-04-15", 24244), ("2022-12-31", 24276), ("2023-10-01", 24286), ("2023-11-01", 24287)])
def test_month_index_and_split(spark, day, index):
    assert column(spark, keys.month_idx(F.lit(day).cast("date"))) == index
    split = {24244: "train", 24276: "train", 24286: "validation", 24287: "test"}[index]
    assert column(spark, sampling.split_of(F.lit(index))) == split
    assert column(spark, sampling.split_of(F.lit(24243))) is None


def test_month_index_is_kept_or_an_error(spark):
    df = frame(spark, [(7,)], "month_idx int")
    assert keys.with_month_idx(df) is df
    with pytest.raises(ValueError, match="neither"):
        keys.with_month_idx(frame(spark, [(7,)], "v int"))


def test_range_and_row_windows(spark):
    df = frame(spark, [(0.0, 0.0, 1, 1.0), (0.0, 0.0, 2, 3.0), (0.0, 0.0, 4, 8.0)], "y double, x double, month_idx int, v double")
    s = Series()
    rows = df.select("month_idx", s.mean_months("v").alias("a"), s.std_months("v").alias("s"), s.mean_rows("v", 6).alias("r")).orderBy("month_idx").collect()
    assert [r["a"] for r in rows] == [1, 2, 5.5]
    assert [r["s"] for r in rows] == pytest.approx([0, math.sqrt(2), 5 / math.sqrt(2)])
    assert [r["r"] for r in rows] == [1, 2, 4]


def test_first_row_of_a_series(spark):
    df = frame(spark, [(0.0, 0.0, 1, 5.0)], "y double, x double, month_idx int, v double")
    s = Series()
    r = df.select(s.step("v").alias("step"), s.momentum("v").alias("m"), s.acceleration("v").alias("a")).first()
    assert (r["step"], r["m"], r["a"]) == (None, 0, 0)


def test_same_series_windows_share_one_exchange(spark):
    df = frame(spark, [(0.0, 0.0, 1, 5.0)], "y double, x double, month_idx int, v double")
    s = Series()
    rows = df.select(s.momentum("v"), s.deseasoned("v"), s.sustained("v"), s.rate("v"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def allocation(spark, rows):
    df = frame(spark, rows, "mascon_id int, dh double, lwe double")
    w = df.where("mascon_id is not null").groupBy("mascon_id").agg(F.count("dh").alias("n"), F.sum(F.abs("dh")).alias("t"))
    out = df.join(w, "mascon_id", "left").select(fusion.allocated(F.col("dh"), F.col("lwe"), F.coalesce("n", F.lit(0)), F.col("t")).alias("v"))
    return sorted((r["v"] for r in out.collect()), key=str)


def test_allocation(spark):
    assert allocation(spark, [(1, -1.0, 10.0), (1, 3.0, 10.0)]) == [15.0, 5.0]
    assert allocation(spark, [(1, 1e-5, 10.0), (1, -1e-5, 10.0)]) == [10.0, 10.0]
    assert allocation(spark, [(1, 1.0, None), (None, 1.0, 10.0)]) == [None, None]


def test_regions(spark):
    at = lambda x, y: column(spark, keys.region_of(F.lit(x), F.lit(y)))
    assert at(-1.2e6, 1.0e6) == "antarctic_peninsula"  # the first of two overlapping boxes
    assert at(0.0, 0.0) == "other"
    assert at(-1.8e6, -1.0e5) == "amundsen_sea"  # edges belong to the box
    assert column(spark, keys.coded(F.lit("nowhere"), keys.REGION_WEIGHTS, 1.0)) == 1.0
    assert column(spark, keys.coded(F.lit(None).cast("string"), keys.REGION_CODES, 6)) == 6


STORE = "regional_subset_id string, mascon_id int, month_idx int, x double, y double, lwe_quarterly_avg double, delta_h double, lwe_fused double"


def test_label(spark):
    rows = [("a", 1, 1, 0.0, float(k), v, h, 0.0) for k, (v, h) in enumerate([(-10.0, -9.0), (0.0, 0.0), (1.0, 1.0), (None, -9.0)])] + [("b", 2, 1, 0.0, 9.0, -5.0, -5.0, 0.0)]
    got = {r["y"]: r[features.LABEL] for r in features.labelled(frame(spark, rows, STORE)).collect()}
    assert got == {0.0: 1, 1.0: 0, 2.0: 0, 3.0: 0, 9.0: 0}  # null mass and a lone row are no hits
    assert "lwe_fused" not in features.labelled(frame(spark, rows, STORE)).columns


def test_ml_ready_adds_what_its_inputs_allow(spark):
    full = "surface bed thickness bed_slope dist_to_grounding_line clamped_depth dist_to_ocean ice_draft ice_area surface_slope h_surface_dynamic thetao_mo t_star_mo so_mo t_f_mo t_star_quarterly_avg t_star_quarterly_std thetao_quarterly_avg thetao_quarterly_std lwe_mo lwe_quarterly_std".split()
    df = frame(spark, [("a", 1, 1, 0.0, 0.0, 1.0, 1.0, 1.0)], STORE).withColumns({c: F.lit(1.0) for c in full}).withColumn("exact_time", F.lit("2020-01-01").cast("timestamp_ntz"))
    out = features.ml_ready(df)
    assert len(set(out.columns) - set(df.columns)) == 42  # 41 features and the label
    assert len(features.numeric_features(out)) == 64
    assert not set(features.LABEL_INPUTS) & set(features.numeric_features(out, exclude_label_inputs=True))


def test_undersampling(spark):
    rows = [("a", 1, k) for k in range(3)] + [("a", 0, k) for k in range(1000)] + [("b", 0, k) for k in range(50)] + [("c", 1, 0), ("c", 0, 1)]
    df = frame(spark, rows, "r string, label int, k int")
    out = sampling.undersampled(df, "label", "r", sampling.draw(["r", "label", "k"]), {"a": 5}).groupBy("r", "label").count().collect()
    n = {(r["r"], r["label"]): r["count"] for r in out}
    assert n[("a", 1)] == 3 and 5 <= n[("a", 0)] <= 30 and not any(k[0] == "b" for k in n) and n[("c", 0)] == 1


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(2000)
    one = {r["id"] for r in sampling.sample(df.coalesce(1), 0.1, ["id"]).collect()}
    many = {r["id"] for r in sampling.sample(df.repartition(7), 0.1, ["id"]).collect()}
    assert one == many and 120 < len(one) < 280


def test_weights_have_mean_one_in_training(spark):
    rows = [("amundsen_sea", 1, 1), ("amundsen_sea", 0, 1), ("amundsen_sea", 0, 1), ("new", 0, 1), ("new", 1, 2)]
    out = sampling.weighted(frame(spark, rows, "r string, label int, m int"), "label", "r", F.col("m") == 1).collect()
    assert np.mean([r["weightCol"] for r in out if r["m"] == 1]) == pytest.approx(1.0)
    w = {(r["r"], r["label"]): r["weightCol"] for r in out}
    assert w[("amundsen_sea", 1)] == pytest.approx(2 * w[("amundsen_sea", 0)])
    assert w[("new", 1)] == pytest.approx(w[("new", 0)])  # no positive in training: ratio 1


def test_freezing_point(spark):
    assert column(spark, physics.freezing_point(F.lit(34.5), F.lit(-500.0))) == pytest.approx(-0.0575 * 34.5 + 0.0901 - 0.3805)
    assert column(spark, physics.pressure(F.lit(10.0))) == 0


def test_polar_coordinates(spark):
    x, y = physics.degrees_to_polar(F.lit(-75.0), F.lit(30.0))
    lat, lon = physics.polar_to_degrees(x, y)
    assert column(spark, lat) == pytest.approx(-75.0, abs=1e-9) and column(spark, lon) == pytest.approx(30.0, abs=1e-9)
    x, y = physics.degrees_to_polar(F.lit(-71.0), F.lit(0.0))
    assert column(spark, y) == pytest.approx(2082760.1, abs=1)  # the circle of true scale


def test_mosaic(spark):
    tiles = frame(spark, [(1, 0, 5.0, None), (1, 1, 6.0, 0.2), (2, 0, 7.0, 0.3), (2, 1, 8.0, 0.3), (3, 0, 1.0, 0.5), (3, 1, 2.0, 0.1)], "cell int, tile int, v double, sigma double")
    assert {r["cell"]: r["v"] for r in raster.mosaic(tiles, ["cell"], ["v"], "sigma", "tile").collect()} == {1: 6.0, 2: 7.0, 3: 2.0}


def cells(spark, z):
    rows = [(iy, ix, None if v is None or math.isnan(v) else float(v)) for iy, row in enumerate(z) for ix, v in enumerate(row)]
    return frame(spark, rows, "iy int, ix int, v double")


def as_array(df, c, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[c] is not None:
            out[r["iy"], r["ix"]] = r[c]
    return out


def test_slope_of_a_plane_and_its_edges(spark):
    z = np.array([[2.0 * x + 3.0 * y for x in range(6)] for y in range(5)])
    s = as_array(raster.slope(cells(spark, z), "v", 1.0), "slope", z.shape)
    assert s[2, 2] == pytest.approx(math.sqrt(13))
    assert s[0, 2] == pytest.approx(math.hypot(2.0, 1.5))  # a border cell stands in for its neighbour
    z[2, 3] = np.nan
    s = as_array(raster.slope(cells(spark, z), "v", 1.0), "slope", z.shape)
    assert np.isnan(s[2, 2]) and np.isnan(s[2, 3]) and not np.isnan(s[3, 2])


def test_distance_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    z = (rng.random((12, 15)) < 0.08).astype(float)
    got = as_array(raster.distance_to(cells(spark, z), F.col("v") == 1, 500.0), "distance", z.shape)
    ys, xs = np.nonzero(z)
    for y in range(12):
        for x in range(15):
            assert got[y, x] == pytest.approx(500 * np.sqrt(((ys - y) ** 2 + (xs - x) ** 2).min()))
    assert np.isnan(as_array(raster.distance_to(cells(spark, z * 0), F.col("v") == 1, 500.0), "distance", z.shape)).all()


def test_bilinear_against_numpy(spark):
    z = np.random.default_rng(1).random((4, 5))
    got = as_array(raster.bilinear(cells(spark, z), "v"), "v", (8, 10))
    for fy in range(8):
        for fx in range(10):
            y, x = (fy + 0.5) / 2 - 0.5, (fx + 0.5) / 2 - 0.5
            a, b = math.floor(y), math.floor(x)
            if a < 0 or b < 0 or a + 1 >= 4 or b + 1 >= 5:
                assert np.isnan(got[fy, fx])
            else:
                p, q = y - a, x - b
                assert got[fy, fx] == pytest.approx(z[a, b] * (1 - p) * (1 - q) + z[a, b + 1] * (1 - p) * q + z[a + 1, b] * p * (1 - q) + z[a + 1, b + 1] * p * q)


def test_depths(spark):
    profile_rows = [(t, [(0.0, 1.0), (10.0, 3.0), (30.0, 7.0)]) for t in (-5.0, 0.0, 20.0, 30.0, 99.0)]
    df = frame(spark, profile_rows, "target double, profile array<struct<depth:double,value:double>>")
    assert {r["target"]: r["value"] for r in raster.at_depth(df).collect()} == {-5.0: 1.0, 0.0: 1.0, 20.0: 5.0, 30.0: 7.0, 99.0: 7.0}
    levels = frame(spark, [(1, 0, 1.0), (1, 1, None), (1, 2, 1.0), (1, 3, None), (2, 0, None)], "c int, level int, v double")
    assert {r["c"]: r["deepest"] for r in raster.deepest_level(levels, ["c"], "v").collect()} == {1: 2, 2: -1}


def test_nearest_point_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    place = lambda n: [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n), strict=True))]
    q, p = place(40), place(60)
    got = {r["q"]: r["distance"] for r in raster.nearest_point(frame(spark, q, "q int, lat double, lon double"), frame(spark, p, "p int, lat double, lon double"), "q", "p").collect()}

    def metres(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * physics.EARTH_RADIUS * math.asin(math.sqrt(h))

    assert len(got) == 40
    for a in q:
        assert got[a[0]] == pytest.approx(min(metres(a, b) for b in p), abs=0.01)


def test_histogram_closes_the_last_bin(spark):
    out = profile.histogram(frame(spark, [(float(v),) for v in (0, 1, 2, 9, 10)], "v double"), "v", 5).orderBy("bin").collect()
    assert [r["n"] for r in out] == [2, 1, 0, 0, 2]


def test_threshold_override_rule_and_labels(spark):
    p = lambda region: column(spark, evaluation.predicted(F.lit(0.4), 0.66, F.lit(region)))
    assert (p("amundsen_sea"), p("ross")) == (1, 0)
    assert column(spark, evaluation.rule(F.lit(None).cast("double"), F.lit(1.0), F.lit(-1.0))) == 0
    fit = lambda a, b: column(spark, evaluation.fit_label(F.lit(a), F.lit(b)))
    assert (fit(0.9902, 0.8), fit(0.87, 0.8), fit(0.83, 0.8), fit(0.55, 0.5)) == ("OVERFITTING", "MILD OVERFITTING", "GOOD FIT", "UNDERFITTING")


def test_confusion_from_rates(spark):
    cells = evaluation.back_calculated(F.lit(0.4916), F.lit(0.8881), F.lit(5_193_607).cast("long"), F.lit(126_716_756).cast("long"))
    got = spark.range(1).select(*(c.alias(n) for n, c in cells.items())).first()
    assert (got["tp"], got["fn"], got["fp"], got["tn"]) == (4_612_442, 581_165, 4_770_068, 116_753_081)


def test_checks_find_what_is_planted(spark):
    df = frame(spark, [(1.0, -3003.0), (2.0, 10.0), (None, 6000.0)], "y double, bed double")
    got = {r["check"]: (r["passed"], r["n_bad"]) for r in quality.range_checks(df).unionByName(quality.null_keys(df, ["y"])).collect()}
    assert got == {"range_bed": (False, 2), "null_y": (False, 1)}
    assert quality.exit_code(quality.null_keys(df, ["y"]), ["null_y"]) == 1
    assert quality.exit_code(quality.range_checks(df)) == 2
    assert {(r["column"], r["passed"]) for r in quality.schema_check(df, {"bed": "float", "y": "int", "z": "any"}).collect()} == {("bed", True), ("y", False), ("z", False)}


def test_missing_bucket_drops_the_row(spark):
    rows = [(1.0, 100.0, "a"), (2.0, None, "b"), (None, 6000.0, "a")]
    df = frame(spark, rows, "v double, d double, r string")
    model = ml.preparation(["v"], "d", "r").fit(df)
    assert model.transform(df).count() == 2


def test_tables(spark, tmp_path):
    a, b, c = (f"file://{tmp_path}/{n}" for n in "abc")
    df = spark.range(10).withColumn("part", F.col("id") % 2)
    tables.save(df, a, by=["part"])
    tables.save(df.withColumn("more", F.lit(1)), b)
    assert tables.scan(spark, a).count() == 10
    assert "part" not in tables.scan(spark, a, recursive=True).columns
    assert tables.partition_of(spark, a, "part", "1").count() == 5
    assert {r["partition"] for r in tables.census(spark, a).collect()} == {"part=0", "part=1"}
    assert tables.discover(spark, [b, c])[1] == [c]
    assert tables.exists(spark, b) and not tables.exists(spark, c)
    assert tables.stage(spark.range(3), b, resume=True).count() == 10
    assert tables.union_by_name([df, tables.scan(spark, b)], missing=True).count() == 20
    assert {r["column"] for r in tables.schema_rows(spark, b).collect()} == {"id", "part", "more"}
    tables.save_sorted(df, c, ["part", "id"])
    assert tables.scan_tagged(spark, {"v": c}, "tag").first()["tag"] == "v"


def test_stream_agrees_with_batch(spark, tmp_path):
    from gridloom.streaming.monthly import monthly_stream

    rows = [(1, "2020-01-05", 1.0), (1, "2020-01-20", 3.0), (1, "2020-03-01", 5.0), (2, "2020-02-01", 2.0)]
    df = frame(spark, rows, "k int, t string, v double").withColumn("time", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(f"{tmp_path}/in")
    stream = monthly_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["k"], "v")
    q = stream.writeStream.format("memory").queryName("monthly").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["k"], r["month_idx"], r["mean"], r["n"]) for r in spark.table("monthly").collect()} == {(1, 24241, 2.0, 2), (1, 24243, 5.0, 1), (2, 24242, 2.0, 1)}
