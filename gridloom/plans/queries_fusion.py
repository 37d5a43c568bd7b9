"""Queries of fusion, windows, labels, features and sampling."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import keys, physics
from gridloom.operators import fusion, groupstats, sampling
from gridloom.operators.windows import Series
from gridloom.plans import domain, features
from gridloom.plans.domain import BOUNDS, BOXES, base_sql, fused_sql, store_sql, table
from gridloom.plans.registry import R, query, rounded

KEYS = "y, x, month_idx"
_FLOATS = "thetao_mo t_star_mo so_mo t_f_mo t_star_quarterly_avg t_star_quarterly_std thetao_quarterly_avg thetao_quarterly_std lwe_mo lwe_quarterly_avg lwe_quarterly_std lwe_fused".split()


def store(spark, sf) -> DataFrame:
    rows = domain.fused(spark, sf).withColumn("regional_subset_id", keys.region_of("x", "y", BOXES))
    return rows.where("regional_subset_id <> 'other'")


def labelled(spark, sf) -> DataFrame:
    return features.labelled(store(spark, sf)).withColumnRenamed(features.LABEL, "label")


def scored(spark, sf) -> DataFrame:
    """Labelled rows with a made-up score that SQL can repeat."""
    s = (F.col("y").cast("long") * 7919 + F.col("month_idx").cast("long") * 104729 + F.col("label") * 300007) % 1000
    return labelled(spark, sf).withColumn("score", s / F.lit(1000.0))


@query(fused_sql(f"SELECT y, x, exact_time, month_idx, mascon_id, delta_h, ice_area, surface, bed, thickness, {R(*_FLOATS)} FROM fused"))
def fused_feature_store(spark, sf):
    return rounded(domain.fused(spark, sf), "y", "x", "exact_time", "month_idx", "mascon_id", "delta_h", "ice_area", "surface", "bed", "thickness", *_FLOATS)


@query(fused_sql(f"SELECT {KEYS}, {R('thetao_mo', 't_star_mo', 'so_mo', 't_f_mo')} FROM ocean_mo"))
def monthly_avg_by_pixel(spark, sf):
    stats = {"thetao_mo": F.avg("thetao"), "t_star_mo": F.avg("T_star"), "so_mo": F.avg("so"), "t_f_mo": F.avg("T_f")}
    return rounded(fusion.monthly(domain.ocean(spark, sf), ["y", "x"], stats))


@query(fused_sql(f"SELECT mascon_id, month_idx, {R('lwe_mo')} FROM grace_mo"))
def monthly_max_by_mascon(spark, sf):
    return rounded(fusion.monthly(domain.grace(spark, sf), ["mascon_id"], {"lwe_mo": F.max("lwe_length")}))


@query(fused_sql(f"SELECT {KEYS}, {R('t_star_quarterly_avg', 't_star_quarterly_std', 'thetao_quarterly_avg', 'thetao_quarterly_std')} FROM ocean_f"))
def rolling_range3_avg_std(spark, sf):
    return rounded(fusion.ocean_features(domain.ocean(spark, sf)), "y", "x", "month_idx", "t_star_quarterly_avg", "t_star_quarterly_std", "thetao_quarterly_avg", "thetao_quarterly_std")


@query(fused_sql(f"SELECT mascon_id, month_idx, {R('lwe_mo', 'lwe_quarterly_avg', 'lwe_quarterly_std')} FROM grace_f"))
def rolling_range3_by_mascon(spark, sf):
    return rounded(fusion.grace_features(domain.grace(spark, sf)))


@query(base_sql("SELECT i.y, i.x, i.time, i.delta_h, s.surface, s.mascon_id FROM icesat i LEFT JOIN (SELECT * FROM static WHERE mask = 1) s ON i.y = s.y AND i.x = s.x"))
def anchored_left_join(spark, sf):
    return domain.icesat(spark, sf).join(domain.static(spark, sf).where("mask = 1"), ["y", "x"], "left").select("y", "x", "time", "delta_h", "surface", "mascon_id")


@query(fused_sql("SELECT c AS \"column\", count(*) AS n_rows, count(v) AS n_hit, round(100.0 * count(v) / nullif(count(*), 0), 1)::DOUBLE AS pct, coalesce(100.0 * count(v) / nullif(count(*), 0) < 50, false) AS low FROM (SELECT unnest(['surface', 'thetao_mo', 'lwe_mo', 'mascon_id']) AS c, unnest([surface, thetao_mo, lwe_mo, mascon_id]) AS v FROM fused) GROUP BY c"))
def join_hit_rate(spark, sf):
    return fusion.hit_rates(domain.fused(spark, sf), ["surface", "thetao_mo", "lwe_mo", "mascon_id"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INT) AS month_idx FROM lineitem")
def month_idx_derivation(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").alias("time"))
    return keys.with_month_idx(rows).drop("time")


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 950 AND 1500 ORDER BY p_size, p_partkey")
def bbox_filter_sorted(spark, sf):
    return table(spark, sf, "part").where(keys.inside("p_size", "p_retailprice", (10, 30, 950, 1500))).orderBy("p_size", "p_partkey").select("p_partkey", "p_size", "p_retailprice")


@query(base_sql(f"SELECT y, x, r AS region FROM (SELECT y, x, {domain._REGION} AS r FROM static) WHERE r <> 'other'"))
def region_assignment(spark, sf):
    return domain.static(spark, sf).select("y", "x", keys.region_of("x", "y", BOXES).alias("region")).where("region <> 'other'")


@query(base_sql("SELECT a.y + 0 AS y, a.x + 0 AS x, b.surface FROM (SELECT round(y + 0.04, 1) AS y, round(x - 0.04, 1) AS x FROM static) a JOIN (SELECT round(y, 1) AS y, round(x, 1) AS x, surface FROM static) b ON a.y = b.y AND a.x = b.x"))
def round_key_join(spark, sf):
    s = domain.static(spark, sf)
    moved = s.select((F.col("y") + 0.04).alias("y"), (F.col("x") - 0.04).alias("x"))
    return fusion.keyed(moved).join(fusion.keyed(s).select("y", "x", "surface"), ["y", "x"]).select((F.col("y") + F.lit(0.0)).alias("y"), (F.col("x") + F.lit(0.0)).alias("x"), "surface")


@query("SELECT * EXCLUDE (p_name, p_type), p_size * 0.1::DOUBLE AS size_tenth FROM part")
def exclude_star_projection(spark, sf):
    return table(spark, sf, "part").drop("p_name", "p_type").withColumn("size_tenth", F.col("p_size") * F.lit(0.1))


@query("SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN 'NaN'::DOUBLE WHEN p_size % 3 = 1 THEN 1e12 ELSE p_size END AS INT) AS whole FROM part")
def try_cast_keys(spark, sf):
    v = F.when(F.col("p_size") % 3 == 0, F.lit(float("nan"))).when(F.col("p_size") % 3 == 1, 1e12).otherwise(F.col("p_size").cast("double"))
    return table(spark, sf, "part").select("p_partkey", v.alias("v")).select("p_partkey", keys.whole("v").alias("whole"))


@query(fused_sql("SELECT y, x, month_idx, lwe_fused IS NOT NULL AS has_mass FROM fused WHERE mascon_id IS NOT NULL AND thetao_mo IS NOT NULL"))
def not_null_anchor_filter(spark, sf):
    return domain.fused(spark, sf).na.drop(subset=["mascon_id", "thetao_mo"]).select("y", "x", "month_idx", F.col("lwe_fused").isNotNull().alias("has_mass"))


_SPLIT = f"CASE WHEN month_idx < {BOUNDS[0]} THEN NULL WHEN month_idx <= {BOUNDS[1]} THEN 'train' WHEN month_idx <= {BOUNDS[2]} THEN 'validation' ELSE 'test' END"


@query(store_sql(f"SELECT {_SPLIT} AS split, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, {R('avg(label) AS pos_rate')} FROM labelled WHERE month_idx >= {BOUNDS[0]} GROUP BY split"))
def temporal_split_summary(spark, sf):
    return rounded(sampling.split_summary(labelled(spark, sf), "label", BOUNDS))


@query(fused_sql(f"SELECT y, x, month_idx, mascon_id, {R('m', 's')}, n FROM fused LEFT JOIN (SELECT mascon_id, avg(delta_h) AS m, stddev_samp(delta_h) AS s, count(*) AS n FROM fused GROUP BY 1) USING (mascon_id)"))
def mascon_group_stats_rejoin(spark, sf):
    rows = domain.fused(spark, sf).select("y", "x", "month_idx", "mascon_id", "delta_h")
    return rounded(groupstats.with_group_stats(rows, ["mascon_id"], {"m": F.avg("delta_h"), "s": F.stddev_samp("delta_h"), "n": F.count(F.lit(1))}), "y", "x", "month_idx", "mascon_id", "m", "s", "n")


@query(store_sql(f"SELECT y, x, month_idx, {R('(delta_h - hm) / (hs + 1e-8) AS z')} FROM store LEFT JOIN heights USING (regional_subset_id, month_idx)"))
def region_month_zscore(spark, sf):
    return rounded(groupstats.group_zscore(store(spark, sf), ["regional_subset_id", "month_idx"], "delta_h", "z"), "y", "x", "month_idx", "z")


@query(store_sql(f"SELECT y, x, month_idx, {R('t_star_mo - coalesce(a, 0) AS t_star_mo_resid', 'so_mo - coalesce(b, 0) AS so_mo_resid')} FROM store LEFT JOIN (SELECT regional_subset_id, avg(t_star_mo) AS a, avg(so_mo) AS b FROM store WHERE month_idx BETWEEN {BOUNDS[0]} AND {BOUNDS[1]} GROUP BY 1) USING (regional_subset_id)"))
def region_residuals_train_only(spark, sf):
    rows = groupstats.residuals(store(spark, sf), ["regional_subset_id"], ["t_star_mo", "so_mo"], F.col("month_idx").between(*BOUNDS[:2]))
    return rounded(rows, "y", "x", "month_idx", "t_star_mo_resid", "so_mo_resid")


_W = "(PARTITION BY y, x ORDER BY month_idx)"
_ROWS = lambda n: f"(PARTITION BY y, x ORDER BY month_idx ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_LAG = lambda c, n=1: f"lag({c}, {n}) OVER {_W}"
S = Series()


def _series(spark, sf, **columns) -> DataFrame:
    return rounded(domain.fused(spark, sf).select("y", "x", "month_idx", *(c.alias(n) for n, c in columns.items())))


@query(fused_sql(f"SELECT {KEYS}, {R(f'avg(delta_h) OVER {_ROWS("UNBOUNDED")} AS mean', f'delta_h - avg(delta_h) OVER {_ROWS("UNBOUNDED")} AS deviation')} FROM fused"))
def pixel_expanding_mean(spark, sf):
    return _series(spark, sf, mean=S.mean_rows("delta_h", None), deviation=F.col("delta_h") - S.mean_rows("delta_h", None))


@query(fused_sql(f"SELECT {KEYS}, {R(f'avg(delta_h) OVER {_ROWS(5)} AS mean6', f'delta_h - coalesce(avg(delta_h) OVER {_ROWS(5)}, delta_h) AS rate', f't_star_mo - coalesce(avg(t_star_mo) OVER {_ROWS(5)}, t_star_mo) AS t_star_rate')} FROM fused"))
def pixel_rolling6_rate(spark, sf):
    return _series(spark, sf, mean6=S.mean_rows("delta_h", 6), rate=S.rate("delta_h"), t_star_rate=S.rate("t_star_mo"))


@query(fused_sql(f"SELECT {KEYS}, {R(f'surface_slope - {_LAG("surface_slope")} AS slope_change', f'delta_h - coalesce({_LAG("delta_h")}, delta_h) AS change')} FROM fused"))
def pixel_lag_change(spark, sf):
    return _series(spark, sf, slope_change=S.step("surface_slope"), change=S.momentum("delta_h"))


@query(fused_sql(f"SELECT {KEYS}, {R(f'delta_h - coalesce({_LAG("delta_h")}, delta_h) AS momentum', f'delta_h - 2 * coalesce({_LAG("delta_h")}, delta_h) + coalesce({_LAG("delta_h", 2)}, delta_h) AS acceleration')} FROM fused"))
def pixel_momentum_accel(spark, sf):
    return _series(spark, sf, momentum=S.momentum("delta_h"), acceleration=S.acceleration("delta_h"))


@query(fused_sql(f"SELECT {KEYS}, {R(f'delta_h - avg(delta_h) OVER {_ROWS(11)} AS deseason')} FROM fused"))
def pixel_deseason12(spark, sf):
    return _series(spark, sf, deseason=S.deseasoned("delta_h"))


@query(fused_sql(f"SELECT {KEYS}, {R(f'avg(t_star_mo) OVER {_ROWS(5)} - avg(t_star_mo) OVER {_ROWS(11)} AS t_star_sustained', f'avg(lwe_mo) OVER {_ROWS(5)} - avg(lwe_mo) OVER {_ROWS(11)} AS lwe_sustained')} FROM fused"))
def pixel_sustained_anomaly(spark, sf):
    return _series(spark, sf, t_star_sustained=S.sustained("t_star_mo"), lwe_sustained=S.sustained("lwe_mo"))


@query(fused_sql(f"SELECT {KEYS}, {R(f'lag(t_star_mo, 1) OVER p AS t1', f'lag(t_star_mo, 3) OVER p AS t3', f'lag(so_mo, 1) OVER p AS s1', f'lag(so_mo, 3) OVER p AS s3')} FROM fused WINDOW p AS (PARTITION BY y, x, {_SPLIT} ORDER BY month_idx)"))
def lag_1_3(spark, sf):
    s = Series(["y", "x", "split"])
    rows = domain.fused(spark, sf).withColumn("split", sampling.split_of(bounds=BOUNDS))
    return rounded(rows.select("y", "x", "month_idx", s.before("t_star_mo").alias("t1"), s.before("t_star_mo", 3).alias("t3"), s.before("so_mo").alias("s1"), s.before("so_mo", 3).alias("s3")))


@query(fused_sql(f"SELECT {KEYS}, {R(f'last_value(thetao_mo IGNORE NULLS) OVER {_ROWS("UNBOUNDED")} AS filled')} FROM fused"))
def pixel_forward_fill(spark, sf):
    return _series(spark, sf, filled=S.filled("thetao_mo"))


@query("SELECT event_id, user_id, round(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts), value) + 2.5e-10, 8) + 0 AS momentum FROM events")
def event_momentum(spark, sf):
    return rounded(table(spark, sf, "events").select("event_id", "user_id", Series(["user_id"], "ts").momentum("value").alias("momentum")))


_CELL = {
    "bed_below_sea_level": "CAST(bed < 0 AS INT)", "draft_x_thermal_access": "ice_draft / (dist_to_ocean + 1)", "grounding_line_vulnerability": "thickness / (dist_to_grounding_line + 1)",
    "retrograde_flag": "CAST(bed_slope < 0 AS INT)", "thermal_driving_x_draft": "t_star_mo * ice_draft", "thermal_anomaly": "t_star_mo - t_star_quarterly_avg",
    "salinity_stratification_proxy": "so_mo * clamped_depth", "lwe_trend": "lwe_mo - lwe_quarterly_avg", "ocean_heat_content_proxy": "thetao_mo * abs(ice_draft) / (dist_to_ocean + 1)",
    "draft_ratio": "abs(ice_draft) / (thickness + 1)", "thermal_x_gl_proximity": "t_star_mo / (dist_to_grounding_line + 1)", "freezing_departure": "thetao_mo - t_f_mo",
    "bed_geometry_risk": "bed_slope * least(bed, 0)", "mass_flux_proxy": "delta_h * ice_area", "sin_month": "sin(month_idx % 12 * 2 * pi() / 12)", "cos_month": "cos(month_idx % 12 * 2 * pi() / 12)",
}


def _cell_sql(names: list[str]) -> str:
    return ", ".join(f"{_CELL[n]} AS {n}" if _CELL[n].startswith("CAST") else R(f"{_CELL[n]} AS {n}") for n in names)


_STATIC = ["bed_below_sea_level", "draft_x_thermal_access", "grounding_line_vulnerability", "retrograde_flag", "draft_ratio", "bed_geometry_risk"]
_PHYSICS = ["thermal_driving_x_draft", "thermal_anomaly", "salinity_stratification_proxy", "lwe_trend", "ocean_heat_content_proxy", "thermal_x_gl_proximity", "freezing_departure", "mass_flux_proxy"]


@query(base_sql(f"SELECT y, x, {_cell_sql(_STATIC)} FROM static"))
def static_ratio_features(spark, sf):
    return rounded(features.made(domain.static(spark, sf), features.CELL), "y", "x", *_STATIC)


@query(fused_sql(f"SELECT {KEYS}, {_cell_sql(_PHYSICS)} FROM fused"))
def physics_interactions(spark, sf):
    return rounded(features.made(domain.fused(spark, sf), features.CELL), "y", "x", "month_idx", *_PHYSICS)


@query(fused_sql(f"SELECT DISTINCT month_idx, {_cell_sql(['sin_month', 'cos_month'])} FROM fused"))
def cyclic_month(spark, sf):
    s, c = keys.cyclic_month("month_idx")
    return rounded(domain.fused(spark, sf).select("month_idx").distinct().select("month_idx", s.alias("sin_month"), c.alias("cos_month")))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('-0.0575 * so + 0.0901 - 7.61e-4 * greatest(-draft, 0) AS t_f', 'l_discount * 30 - (-0.0575 * so + 0.0901 - 7.61e-4 * greatest(-draft, 0)) AS t_star')} FROM (SELECT *, CAST(30 + l_quantity / 10 AS DOUBLE) AS so, CAST(10 - l_quantity * 20 AS DOUBLE) AS draft FROM lineitem)")
def thermal_freezing_point(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({"so": 30 + F.col("l_quantity") / 10, "draft": 10 - F.col("l_quantity") * 20, "theta": F.col("l_discount") * 30})
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", physics.freezing_point("so", "draft").alias("t_f"), physics.thermal_driving("theta", "so", "draft").alias("t_star")))


@query(store_sql(f"SELECT {KEYS}, regional_subset_id, label FROM labelled"))
def label_dual_sensor(spark, sf):
    return labelled(spark, sf).select("y", "x", "month_idx", "regional_subset_id", "label")


@query(store_sql(f"SELECT {KEYS}, CAST(coalesce(lwe_quarterly_avg < lm - 0.5 * ls, false) AS INT) AS label FROM store LEFT JOIN stats USING (regional_subset_id, mascon_id)"))
def label_grace_only(spark, sf):
    return features.labelled(store(spark, sf), "grace_anomaly").select("y", "x", "month_idx", F.col(features.LABEL).alias("label"))


@query(fused_sql(f"SELECT {KEYS}, CAST(coalesce(round(lwe_fused, 6) < p, false) AND coalesce(delta_h < m - s, false) AS INT) AS label FROM fused LEFT JOIN (SELECT mascon_id, month_idx, quantile_cont(round(lwe_fused, 6), 0.25) AS p FROM fused GROUP BY ALL) USING (mascon_id, month_idx) LEFT JOIN (SELECT y, x, round(avg(delta_h), 9) AS m, round(stddev_samp(delta_h), 9) AS s FROM fused GROUP BY ALL) USING (y, x)"))
def label_p25_pixel_sigma(spark, sf):
    rows = domain.fused(spark, sf).withColumn("lwe_fused", F.round("lwe_fused", 6))
    return features.labelled_by_percentile(rows).select("y", "x", "month_idx", F.col(features.LABEL).alias("label"))


_WEIGHT = "CASE regional_subset_id " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in keys.REGION_WEIGHTS.items()) + " ELSE 1.0 END"
_CODE = "CASE regional_subset_id " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in keys.REGION_CODES.items()) + " ELSE 6 END"
_RATIOS = f"SELECT regional_subset_id, count(*) FILTER (WHERE label = 0) AS neg_count, count(*) FILTER (WHERE label = 1) AS pos_count FROM labelled WHERE month_idx BETWEEN {BOUNDS[0]} AND {BOUNDS[1]} GROUP BY 1"


def _train():
    return F.col("month_idx").between(*BOUNDS[:2])


@query(store_sql(f"SELECT DISTINCT regional_subset_id, CAST({_WEIGHT} AS DOUBLE) AS weight, CAST({_CODE} AS INT) AS code FROM store"))
def region_weights_and_codes(spark, sf):
    rows = store(spark, sf).select("regional_subset_id").distinct()
    return rows.select("regional_subset_id", keys.coded("regional_subset_id", keys.REGION_WEIGHTS, 1.0).alias("weight"), keys.coded("regional_subset_id", keys.REGION_CODES, 6).alias("code"))


@query(store_sql(f"SELECT *, {R('CASE WHEN pos_count > 0 THEN neg_count / pos_count ELSE 1 END AS class_ratio')} FROM ({_RATIOS})"))
def class_ratio(spark, sf):
    return rounded(sampling.class_ratios(labelled(spark, sf), "label", "regional_subset_id", _train()))


@query(store_sql(f"SELECT {KEYS}, {R('raw / (SELECT avg(raw) FROM w WHERE month_idx BETWEEN ' + f'{BOUNDS[0]} AND {BOUNDS[1]}) AS weight')} FROM w").replace("\nSELECT", f",\nw AS (SELECT l.*, {_WEIGHT}::DOUBLE * CASE WHEN label = 1 THEN CASE WHEN pos_count > 0 THEN neg_count / pos_count ELSE 1 END ELSE 1 END AS raw FROM labelled l LEFT JOIN ({_RATIOS}) USING (regional_subset_id))\nSELECT", 1))
def sample_weights(spark, sf):
    return rounded(sampling.weighted(labelled(spark, sf), "label", "regional_subset_id", _train(), out="weight"), "y", "x", "month_idx", "weight")


@query(store_sql(f"SELECT neg, pos, {R('least(neg / greatest(pos, 1), 15) AS scale_pos_weight')} FROM (SELECT count(*) FILTER (WHERE label = 0) AS neg, count(*) FILTER (WHERE label = 1) AS pos FROM labelled)"))
def scale_pos_weight(spark, sf):
    return rounded(sampling.scale_pos_weight(labelled(spark, sf), "label"))


_RATIO = "CASE regional_subset_id " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in keys.NEGATIVES_PER_POSITIVE.items()) + " ELSE 10 END"
_DRAW = "((CAST(y AS BIGINT) * 7919 + month_idx * 31 + 42) % 1000) / 1000.0::DOUBLE"


@query(store_sql(f"SELECT {KEYS}, label FROM labelled JOIN (SELECT regional_subset_id, least(1, sum(label) * {_RATIO} / greatest(sum(1 - label), 1)) AS share FROM labelled GROUP BY 1 HAVING sum(label) > 0) USING (regional_subset_id) WHERE label = 1 OR {_DRAW} < share"))
def undersample_stratified(spark, sf):
    draw = ((F.col("y").cast("long") * 7919 + F.col("month_idx") * 31 + 42) % 1000) / F.lit(1000.0)
    return sampling.undersampled(labelled(spark, sf), "label", "regional_subset_id", draw).select("y", "x", "month_idx", "label")


@query(store_sql(f"SELECT {KEYS}, label FROM labelled, (SELECT least(1, sum(label) * 10 / greatest(sum(1 - label), 1)) AS share FROM labelled) WHERE label = 1 OR {_DRAW} < share"))
def undersample_global(spark, sf):
    draw = ((F.col("y").cast("long") * 7919 + F.col("month_idx") * 31 + 42) % 1000) / F.lit(1000.0)
    rows = labelled(spark, sf).withColumn("all", F.lit("all"))
    return sampling.undersampled(rows, "label", "all", draw, {}).select("y", "x", "month_idx", "label")


@query(fused_sql("SELECT fold, count(*) AS n, min(month_idx) AS first, max(month_idx) AS last FROM (SELECT month_idx, CASE WHEN month_idx <= (SELECT floor((min(month_idx) + max(month_idx)) / 2) FROM fused) THEN 'a' ELSE 'b' END AS fold FROM fused) GROUP BY fold"))
def oof_temporal_fold(spark, sf):
    return sampling.fold_of(domain.fused(spark, sf)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("month_idx").alias("first"), F.max("month_idx").alias("last"))


@query(store_sql("SELECT regional_subset_id, y, x, month_idx, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY regional_subset_id, label ORDER BY score, y, x, month_idx) AS rn FROM scored) WHERE rn <= 20"))
def stratified_first_n(spark, sf):
    rows = sampling.first_n(scored(spark, sf), ["regional_subset_id", "label"], [F.col(c) for c in ("score", "y", "x", "month_idx")], 20)
    return rows.select("regional_subset_id", "y", "x", "month_idx", "rn")


_KEY = "l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE CAST('0x' || substr(md5('42:' || {_KEY}), 1, 8) AS BIGINT) / 4294967296.0 < 0.1")
def hash_sample(spark, sf):
    keys_ = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return sampling.sample(table(spark, sf, "lineitem"), 0.1, keys_).select(*keys_, "l_quantity")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN d < 0.7 THEN 0 WHEN d < 0.85 THEN 1 ELSE 2 END AS INT) AS part FROM (SELECT *, CAST('0x' || substr(md5('42:' || {_KEY}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS d FROM lineitem)")
def random_split(spark, sf):
    keys_ = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return sampling.random_parts(table(spark, sf, "lineitem").select(*keys_), [0.7, 0.15, 0.15], keys_)


@query(fused_sql("SELECT split, count(*) AS n, min(month_idx) AS first, max(month_idx) AS last FROM (SELECT month_idx, CASE WHEN month_idx < 23990 THEN 'train' ELSE 'test' END AS split FROM fused WHERE lwe_fused IS NOT NULL AND t_star_mo IS NOT NULL) GROUP BY split"))
def two_way_split(spark, sf):
    rows = sampling.two_way(domain.fused(spark, sf), ["lwe_fused", "t_star_mo"], first_test=23990)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("month_idx").alias("first"), F.max("month_idx").alias("last"))


_SECOND = "CASE regional_subset_id " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in features.SECOND_WEIGHTS.items()) + " ELSE 1.0 END"


@query(store_sql(f"SELECT {KEYS}, {R(f'raw * {_SECOND} / (SELECT avg(raw) FROM w WHERE month_idx BETWEEN {BOUNDS[0]} AND {BOUNDS[1]}) AS weight')} FROM w").replace("\nSELECT", f",\nw AS (SELECT l.*, {_WEIGHT}::DOUBLE * CASE WHEN label = 1 THEN CASE WHEN pos_count > 0 THEN neg_count / pos_count ELSE 1 END ELSE 1 END AS raw FROM labelled l LEFT JOIN ({_RATIOS}) USING (regional_subset_id))\nSELECT", 1))
def compounded_weights(spark, sf):
    rows = sampling.weighted(labelled(spark, sf), "label", "regional_subset_id", _train(), out="weight")
    return rounded(sampling.reweighted(rows, "regional_subset_id", features.SECOND_WEIGHTS, "weight"), "y", "x", "month_idx", "weight")


_RG = "PARTITION BY regional_subset_id, month_idx"
_READY_SQL = {
    "mascon_mean_delta_h": "CASE WHEN mascon_id IS NOT NULL THEN avg(delta_h) OVER (PARTITION BY mascon_id, month_idx) END", "mascon_mean_t_star": "CASE WHEN mascon_id IS NOT NULL THEN avg(t_star_mo) OVER (PARTITION BY mascon_id, month_idx) END",
    "regional_t_star_climatology": f"avg(t_star_mo) OVER ({_RG})", "regional_lwe_mean": f"avg(lwe_mo) OVER ({_RG})", "regional_t_star_anomaly": f"t_star_mo - avg(t_star_mo) OVER ({_RG})",
    "regional_delta_h_percentile": f"(delta_h - avg(delta_h) OVER ({_RG})) / (stddev_samp(delta_h) OVER ({_RG}) + 1e-8)",
    "pixel_mean_delta_h": f"avg(delta_h) OVER {_ROWS('UNBOUNDED')}", "delta_h_deviation": f"delta_h - avg(delta_h) OVER {_ROWS('UNBOUNDED')}", "surface_slope_change": f"surface_slope - {_LAG('surface_slope')}",
    "delta_h_acceleration": f"delta_h - 2 * coalesce({_LAG('delta_h')}, delta_h) + coalesce({_LAG('delta_h', 2)}, delta_h)", "delta_h_deseason": f"delta_h - avg(delta_h) OVER {_ROWS(11)}",
    **{name: f"{c} - coalesce({_LAG(c)}, {c})" for name, c in (("t_star_mom_change", "t_star_mo"), ("delta_h_mom_change", "delta_h"), ("delta_h_momentum", "delta_h"), ("t_star_momentum", "t_star_mo"), ("lwe_momentum", "lwe_mo"))},
    **{name: f"avg({c}) OVER {_ROWS(5)} - avg({c}) OVER {_ROWS(11)}" for name, c in (("t_star_sustained_anomaly", "t_star_mo"), ("lwe_sustained_trend", "lwe_mo"))},
    **{f"{name}_6mo_avg": f"avg({c}) OVER {_ROWS(5)}" for name, c in (("t_star", "t_star_mo"), ("lwe", "lwe_mo"), ("delta_h", "delta_h"))},
    **{f"{name}_rate": f"{c} - coalesce(avg({c}) OVER {_ROWS(5)}, {c})" for name, c in (("t_star", "t_star_mo"), ("lwe", "lwe_mo"), ("delta_h", "delta_h"))},
    **_CELL, "region_cat_idx": _CODE,
}
_READY = list(_READY_SQL)


@query(store_sql("SELECT " + KEYS + ", label, " + ", ".join(f"{c} AS {n}" if c.startswith("CAST") else f"CAST({c} AS INT) AS {n}" if n == "region_cat_idx" else R(f"{c} AS {n}") for n, c in _READY_SQL.items()) + " FROM labelled"))
def ml_ready_features(spark, sf):
    """All 41 further columns."""
    return rounded(features.ml_ready(store(spark, sf)).withColumnRenamed(features.LABEL, "label"), "y", "x", "month_idx", "label", *_READY)


@query("SELECT CAST(k AS INT) AS place, c AS feature FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in features.NUMERIC if c not in ("h_surface_dynamic",)) + "]) AS c, unnest(range(0, 63)) AS k)")
def numeric_feature_order(spark, sf):
    names = features.numeric_features(features.firewalled(features.ml_ready(store(spark, sf))))
    return spark.createDataFrame(list(enumerate(names)), "place int, feature string")


_MONTHLY = ["thetao_mo", "t_star_mo", "so_mo", "t_f_mo", "thetao_quarterly_avg", "thetao_quarterly_std", "t_star_quarterly_avg", "t_star_quarterly_std"]
_LAGGED = [f"lag({c}, {n}) OVER (PARTITION BY x, y ORDER BY month_idx) AS {c}_lag{n}" for c in features.LAGGED for n in features.LAGS]
_MADE = ["thetao_mo - t_f_mo AS thermal_driving", "t_star_mo - regional_t_star_climatology AS t_star_anomaly", "sin(2.0 * 3.14159265::DOUBLE * month_idx / 12.0) AS sin_month", "cos(2.0 * 3.14159265::DOUBLE * month_idx / 12.0) AS cos_month"]
_KEPT = ["dist_to_grounding_line AS dist_to_grounding_line", "thickness / (dist_to_grounding_line + 1) AS grounding_line_vulnerability", "CAST(bed_slope < 0 AS INT) AS retrograde_flag", "bed_slope AS bed_slope", "bed AS bed", "clamped_depth AS clamped_depth", "ice_draft AS ice_draft", "thickness AS thickness", "ice_area AS ice_area", "lwe_mo - lwe_quarterly_avg AS lwe_trend"]
_MEANS = ", ".join(f"avg({c}) AS m_{c}" for c in [*_MONTHLY, "regional_t_star_climatology"])


@query(
    store_sql(f"SELECT {KEYS}, {R(*(f'{c} - coalesce(m_{c}, 0) AS {c}_resid' for c in [*_MONTHLY, 'regional_t_star_climatology']), *_LAGGED, *_MADE, *_KEPT)} FROM r2 LEFT JOIN (SELECT regional_subset_id, {_MEANS} FROM r2 WHERE month_idx BETWEEN {BOUNDS[0]} AND {BOUNDS[1]} GROUP BY 1) USING (regional_subset_id)").replace(
        "\nSELECT", ",\nr2 AS (SELECT *, avg(t_star_mo) OVER (PARTITION BY regional_subset_id, month_idx) AS regional_t_star_climatology FROM labelled)\nSELECT", 1
    )
)
def second_feature_set(spark, sf):
    """The 27 columns of the second model."""
    rows, names = features.second_set(features.ml_ready(store(spark, sf)), _train())
    rows = rows.withColumns({c: F.col(c).cast("double") for c in names})
    return rounded(rows, "y", "x", "month_idx", *names)
