"""Queries of profiles, quality checks and evaluation."""

from pyspark.sql import functions as F

from gridloom.operators import evaluation, profile, quality
from gridloom.plans import domain
from gridloom.plans.domain import base_sql, fused_sql, store_sql, table
from gridloom.plans.queries_fusion import KEYS, scored
from gridloom.plans.registry import R, query, rounded

_PARTS = ["surface", "thetao_mo", "lwe_mo", "lwe_fused", "clamped_depth"]
_UNNEST = lambda cols, src: f"(SELECT unnest([{', '.join(repr(c) for c in cols)}]) AS c, unnest([{', '.join(f'{c}::DOUBLE' for c in cols)}]) AS v FROM {src})"
_NUM = ["p_size", "p_retailprice", "p_partkey"]


@query(fused_sql(f"SELECT c AS \"column\", count(*) AS n, count(v) AS n_present, count(*) - count(v) AS n_null, round(100.0 * count(v) / count(*), 2)::DOUBLE AS pct FROM {_UNNEST(_PARTS, 'fused')} GROUP BY c"))
def completeness_report(spark, sf):
    return profile.completeness(domain.fused(spark, sf), _PARTS)


@query("SELECT c AS \"column\", count(*) FILTER (WHERE v IS NULL OR isnan(v)) / count(*) AS ratio FROM (SELECT unnest(['a', 'b']) AS c, unnest([CASE WHEN p_size % 4 = 0 THEN 'NaN'::DOUBLE WHEN p_size % 4 = 1 THEN NULL ELSE p_retailprice END, p_size::DOUBLE]) AS v FROM part) GROUP BY c")
def missing_ratio(spark, sf):
    s = F.col("p_size")
    rows = table(spark, sf, "part").select(F.when(s % 4 == 0, F.lit(float("nan"))).when(s % 4 == 1, None).otherwise(F.col("p_retailprice")).alias("a"), s.alias("b"))
    return profile.missing_ratio(rows)


@query(f"SELECT c AS \"column\", count(v) AS n, min(v) AS min, max(v) AS max, {R('avg(v) AS mean', 'stddev_samp(v) AS stddev')} FROM {_UNNEST(_NUM, 'part')} GROUP BY c")
def range_stats(spark, sf):
    return rounded(profile.range_stats(table(spark, sf, "part"), _NUM))


_LINE = ["l_quantity", "l_tax", "l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount"]


@query(f"SELECT c AS \"column\", count(v) AS n, min(v) AS min, max(v) AS max, {R('avg(v) AS mean', 'stddev_samp(v) AS stddev')} FROM {_UNNEST(_LINE, 'lineitem')} GROUP BY c")
def numeric_summary(spark, sf):
    return rounded(profile.range_stats(table(spark, sf, "lineitem")))


@query(base_sql("SELECT count(DISTINCT (y, x)) AS n_pixels, count(DISTINCT time) AS n_months FROM icesat"))
def distinct_pixels_months(spark, sf):
    return profile.distinct_counts(domain.icesat(spark, sf), n_pixels=["y", "x"], n_months=["time"])


@query(f"SELECT l_returnflag, count(*) AS n, {R('avg(l_extendedprice) AS mean')} FROM lineitem GROUP BY 1 ORDER BY 1")
def category_distribution(spark, sf):
    return rounded(profile.distribution(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice").orderBy("l_returnflag"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS cnt FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(base_sql("SELECT DISTINCT y, x FROM ocean EXCEPT SELECT y, x FROM static WHERE mask = 1"))
def orphans_except(spark, sf):
    return quality.orphans(domain.ocean(spark, sf), domain.static(spark, sf).where("mask = 1"), ["y", "x"])


@query("SELECT count(DISTINCT l_partkey) AS n_orphans FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON l_partkey = p_partkey WHERE p_partkey IS NULL")
def orphans_anti(spark, sf):
    part = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return quality.orphan_count(table(spark, sf, "lineitem"), part, "l_partkey")


@query(base_sql("SELECT DISTINCT CAST(year(time) * 12 + month(time) AS INT) AS m FROM icesat INTERSECT SELECT CAST(year(time) * 12 + month(time) AS INT) FROM grace"))
def shared_months_intersect(spark, sf):
    from gridloom.functions.keys import month_idx

    return quality.shared(domain.icesat(spark, sf).select(month_idx("time").alias("m")), domain.grace(spark, sf).select(month_idx("time").alias("m")), ["m"])


@query(base_sql("SELECT 'icesat' AS \"table\", min(time) AS first, max(time) AS last FROM icesat UNION ALL SELECT 'ocean', min(time), max(time) FROM ocean UNION ALL SELECT 'grace', min(time), max(time) FROM grace"))
def span_union_all(spark, sf):
    return quality.spans({"icesat": (domain.icesat(spark, sf), "time"), "ocean": (domain.ocean(spark, sf), "time"), "grace": (domain.grace(spark, sf), "time")})


@query(base_sql("SELECT (SELECT min(time) FROM ocean) >= (SELECT min(time) FROM grace) AS starts_within, (SELECT max(time) FROM ocean) <= (SELECT max(time) FROM grace) AS ends_within"))
def time_span_containment(spark, sf):
    return quality.contained(domain.ocean(spark, sf), domain.grace(spark, sf), "time")


@query("WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 50 AS step FROM lineitem), b AS (SELECT CAST(least(floor((l_extendedprice - lo) / step), 49) AS INT) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1) SELECT CAST(k AS INT) AS bin, " + R("lo + k * step AS low", "lo + (k + 1) * step AS high") + ", coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 50)) AS k) CROSS JOIN e LEFT JOIN b ON b.bin = k")
def histogram_equal_width(spark, sf):
    return rounded(profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50))


@query(f"SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS cx, CAST(floor(l_discount / 0.02::DOUBLE) AS BIGINT) AS cy, {R('avg(l_extendedprice) AS mean')}, count(l_extendedprice) AS n FROM lineitem GROUP BY 1, 2")
def mean_by_cell_2d(spark, sf):
    return rounded(profile.mean_by_cell(table(spark, sf, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", 5.0, 0.02))


_HEX = "round(u - o) + o"


@query(f"WITH p AS (SELECT l_quantity / 7.0::DOUBLE AS u, l_tax * 100 / (7.0::DOUBLE * sqrt(3.0::DOUBLE)) AS v, l_extendedprice FROM lineitem), c AS (SELECT *, round(u) AS a0, round(v) AS b0, round(u - 0.5) + 0.5 AS a1, round(v - 0.5) + 0.5 AS b1 FROM p), h AS (SELECT *, pow(u - a0, 2) + 3 * pow(v - b0, 2) <= pow(u - a1, 2) + 3 * pow(v - b1, 2) AS first FROM c) SELECT {R('CASE WHEN first THEN a0 ELSE a1 END * 7 AS hx', 'CASE WHEN first THEN b0 ELSE b1 END * (7.0::DOUBLE * sqrt(3.0::DOUBLE)) AS hy')}, {R('avg(l_extendedprice) AS mean')}, count(*) AS n FROM h GROUP BY 1, 2")
def hexbin_mean_2d(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_tax") * 100).alias("tax"), "l_extendedprice")
    return rounded(profile.hexbin(rows, "l_quantity", "tax", "l_extendedprice", 7.0))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT a, b, round(c + 2.5e-10, 8) + 0 AS corr FROM (SELECT unnest([" + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'c': coalesce(corr({a}, {b}), 0)}}" for a in _CORR for b in _CORR) + "], recursive := true) FROM lineitem)")
def corr_matrix_long(spark, sf):
    return rounded(profile.correlations(table(spark, sf, "lineitem"), _CORR))


@query(f"SELECT c AS \"column\", {R('quantile_cont(v, 0.01) AS p_low', 'quantile_cont(v, 0.99) AS p_high', 'min(v) AS min', 'max(v) AS max', 'avg(v) AS mean')} FROM {_UNNEST(['l_quantity', 'l_extendedprice'], 'lineitem')} GROUP BY c")
def percentile_bounds(spark, sf):
    return rounded(profile.bounds(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query(fused_sql(f"SELECT CAST(date_trunc('month', exact_time) AS TIMESTAMP) AS month, {R('avg(lwe_fused) AS mean')}, count(lwe_fused) AS n FROM fused GROUP BY 1"))
def monthly_trunc_means(spark, sf):
    return rounded(profile.monthly_means(domain.fused(spark, sf), "exact_time", ["lwe_fused", "lwe_mo", "lwe_length"]))


@query(f"WITH m AS (SELECT CAST(dayofyear(ts) AS INT) AS d, avg(value) AS v FROM events GROUP BY 1) SELECT {R('round(regr_slope(v, d), 4) AS slope', 'round(regr_intercept(v, d), 2) AS intercept')} FROM m")
def linear_trend(spark, sf):
    days = table(spark, sf, "events").groupBy(F.dayofyear("ts").alias("d")).agg(F.avg("value").alias("v"))
    line = profile.trend(days, F.col("d"), F.col("v"))
    return rounded(line.select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept")))


_CHECKS = {f"anchor_{a}": f"{a} IS NULL" for a in ("y", "x", "exact_time", "month_idx", "delta_h")}
for _n in ("t_star", "thetao", "lwe"):
    _CHECKS |= {f"std_{_n}": f"{_n}_quarterly_avg IS NOT NULL AND {_n}_quarterly_std IS NULL", f"std_sign_{_n}": f"{_n}_quarterly_std < 0"}
_CHECKS |= {"sign_flip": "sign(lwe_fused) <> sign(lwe_mo) AND lwe_fused <> 0", "allocated_without_mascon": "mascon_id IS NULL AND lwe_fused IS NOT NULL", "bed_above_surface": "bed > surface"}


def _checks_sql(checks: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) FILTER (WHERE {c}) = 0 AS passed, count(*) FILTER (WHERE {c}) AS n_bad, count(*) AS n FROM {source}" for k, c in checks.items())


@query(fused_sql(_checks_sql(_CHECKS, "fused")))
def coalesce_std_integrity(spark, sf):
    return quality.fused_checks(domain.fused(spark, sf))


_RANGED = {c: r for c, r in quality.RANGES.items() if c in ("surface", "bed", "thickness", "bed_slope", "dist_to_grounding_line", "clamped_depth", "dist_to_ocean", "ice_draft")}


@query(base_sql(_checks_sql({f"range_{c}": f"{c} < {lo} OR {c} > {hi}" for c, (lo, hi) in _RANGED.items()}, "static")))
def physical_range_checks(spark, sf):
    return quality.range_checks(domain.static(spark, sf))


@query(base_sql(_checks_sql({"null_y": "y IS NULL", "null_mascon_id": "mascon_id IS NULL"}, "static") + " UNION ALL " + _checks_sql({"bounds_y": "NOT y BETWEEN -3500000 AND 3500000", "bounds_x": "NOT x BETWEEN -3500000 AND 3500000"}, "static") + " UNION ALL " + _checks_sql({"span_time": "time < '1996-01-01' OR time >= '2000-01-01'"}, "icesat")))
def key_and_bound_checks(spark, sf):
    s = domain.static(spark, sf)
    return quality.null_keys(s, ["y", "mascon_id"]).unionByName(quality.coordinate_checks(s)).unionByName(quality.time_check(domain.icesat(spark, sf), "time", ("1996-01-01", "2000-01-01")))


@query("SELECT * FROM (VALUES ('p_partkey', 'bigint', true), ('p_retailprice', 'double', true), ('p_name', 'string', false), ('p_height', NULL, false)) t(\"column\", \"type\", passed)")
def schema_family_check(spark, sf):
    return quality.schema_check(table(spark, sf, "part"), {"p_partkey": "int", "p_retailprice": "float", "p_name": "ts", "p_height": "any"})


@query(fused_sql(f"SELECT count(*) AS n_groups, {R('max(drift) AS max_drift', 'avg(drift) AS mean_drift')}, count(*) FILTER (WHERE drift > 1e-3) AS n_violations FROM (SELECT abs(sum(lwe_fused) - max(lwe_mo) * count(*)) AS drift FROM fused WHERE lwe_fused IS NOT NULL GROUP BY mascon_id, month_idx)"))
def allocation_conservation(spark, sf):
    return rounded(quality.conservation(domain.fused(spark, sf)))


@query(fused_sql("SELECT mascon_id, month_idx, count(*) AS n FROM fused WHERE lwe_fused IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, mascon_id, month_idx LIMIT 5"))
def topk_worst_drift(spark, sf):
    return quality.drifts(domain.fused(spark, sf)).orderBy(F.desc("n"), "mascon_id", "month_idx").limit(5).select("mascon_id", "month_idx", "n")


@query(_checks_sql({"warn_magnitude": "abs(l_extendedprice) > 50000", "outside_limits": "l_extendedprice < 0 OR l_extendedprice > 90000"}, "lineitem"))
def tile_physics_audit(spark, sf):
    return quality.tile_audit(table(spark, sf, "lineitem"), "l_extendedprice", 50000.0, 0.0, 90000.0)


_P = "CAST(score >= 0.5 AS INT)"


def _confusion_sql(source: str, by: str = "") -> str:
    cells = "count(*) FILTER (WHERE p = 1 AND label = 1) AS tp, count(*) FILTER (WHERE p = 1 AND label = 0) AS fp, count(*) FILTER (WHERE p = 0 AND label = 1) AS fn, count(*) FILTER (WHERE p = 0 AND label = 0) AS tn"
    rate = lambda a, b, n: f"CASE WHEN {b} > 0 THEN {a} / ({b}) ELSE 0 END AS {n}"
    return f"SELECT *, {R(rate('tp', 'tp + fp', 'precision'), rate('tp', 'tp + fn', 'recall'), rate('fn', 'tp + fn', 'fnr'), rate('fp', 'fp + tn', 'fpr'))} FROM (SELECT {by + ',' if by else ''} {cells} FROM {source} {'GROUP BY ' + by if by else ''})"


def _predicted(spark, sf):
    return scored(spark, sf).withColumn("p", evaluation.predicted(F.col("score"), 0.5))


@query(store_sql(_confusion_sql(f"(SELECT *, {_P} AS p FROM scored)")))
def confusion_counts(spark, sf):
    return rounded(evaluation.confusion(_predicted(spark, sf), "p", "label"))


@query(store_sql(_confusion_sql(f"(SELECT *, {_P} AS p FROM scored)", "regional_subset_id, month_idx")))
def monthly_fnr_fpr(spark, sf):
    return rounded(evaluation.confusion(_predicted(spark, sf), "p", "label", ["regional_subset_id", "month_idx"]))


@query(store_sql(f"SELECT {KEYS}, CASE WHEN p = 1 AND label = 1 THEN 'TP' WHEN p = 1 THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN' END AS kind FROM (SELECT *, {_P} AS p FROM scored)"))
def error_types(spark, sf):
    return _predicted(spark, sf).select("y", "x", "month_idx", evaluation.error_type(F.col("p"), F.col("label")).alias("kind"))


@query(store_sql(f"SELECT regional_subset_id, {R('avg(score) AS mean_prediction', 'avg(label) AS true_rate')}, count(*) AS n FROM scored GROUP BY 1 ORDER BY 1"))
def regional_summary(spark, sf):
    return rounded(evaluation.region_summary(scored(spark, sf), "score", "label", "regional_subset_id").orderBy("regional_subset_id"))


def _sweep_sql(thresholds, beta: float) -> str:
    b = beta * beta
    counts = f"SELECT t AS threshold, count(*) FILTER (WHERE score >= t AND label = 1) AS tp, count(*) FILTER (WHERE score >= t AND label = 0) AS fp, count(*) FILTER (WHERE score < t AND label = 1) AS fn FROM scored CROSS JOIN (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in thresholds)}]) AS t) GROUP BY t"
    pr = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall"
    f = f"CASE WHEN {b} * precision + recall > 0 THEN (1 + {b}) * precision * recall / ({b} * precision + recall) ELSE 0 END AS f"
    return f"SELECT threshold, tp, fp, fn, {R('precision', 'recall', f)} FROM (SELECT *, {pr} FROM ({counts}))"


F2_THRESHOLDS = [round(0.10 + 0.02 * k, 2) for k in range(43)]


@query(store_sql(_sweep_sql(evaluation.F1_THRESHOLDS, 1.0)))
def threshold_sweep_f1(spark, sf):
    return rounded(evaluation.sweep(scored(spark, sf), "score", "label"))


@query(store_sql(_sweep_sql(F2_THRESHOLDS, 2.0)))
def threshold_sweep_f2(spark, sf):
    return rounded(evaluation.sweep(scored(spark, sf), "score", "label", F2_THRESHOLDS, 2.0))


@query(store_sql(f"SELECT {R('threshold', 'f')} FROM ({_sweep_sql(F2_THRESHOLDS, 2.0)}) ORDER BY f DESC, threshold LIMIT 1"))
def best_f2_threshold(spark, sf):
    return rounded(evaluation.best_threshold(evaluation.sweep(scored(spark, sf), "score", "label", F2_THRESHOLDS, 2.0)))


@query(store_sql(f"SELECT {KEYS}, CAST(score >= CASE WHEN regional_subset_id = 'amundsen_sea' THEN 0.35 ELSE 0.66 END AS INT) AS p FROM scored"))
def region_override_threshold(spark, sf):
    return scored(spark, sf).select("y", "x", "month_idx", evaluation.predicted(F.col("score"), 0.66, F.col("regional_subset_id")).alias("p"))


_confusion_by_sql = f"SELECT regional_subset_id, CASE WHEN sum(label) > 0 THEN count(*) FILTER (WHERE q = 1 AND label = 1) / sum(label) ELSE 0 END AS tpr, CASE WHEN sum(1 - label) > 0 THEN count(*) FILTER (WHERE q = 1 AND label = 0) / sum(1 - label) ELSE 0 END AS fpr FROM (SELECT *, {_P} AS q FROM scored) GROUP BY 1"


@query(store_sql("WITH d AS (SELECT regional_subset_id AS r, score AS s, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM d WINDOW w AS (PARTITION BY r ORDER BY s DESC)) " f"SELECT r AS regional_subset_id, {R('CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum((tp - p / 2) * n) / (sum(p) * sum(n)) END AS roc_auc', 'CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * tp / (tp + fp)) / sum(p) END AS pr_auc')}, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg FROM c GROUP BY r").replace("\nWITH d", ",\nd", 1))
def ranking_by_region(spark, sf):
    return rounded(evaluation.ranking(scored(spark, sf), "score", "label", ["regional_subset_id"]))


@query(store_sql(f"WITH c0 AS ({_confusion_by_sql}), d AS (SELECT regional_subset_id AS r, score AS s, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM d WINDOW w AS (PARTITION BY r ORDER BY s DESC)), "
    f"a AS (SELECT r, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * tp / (tp + fp)) / sum(p) END AS area, CAST(sum(p) AS BIGINT) AS n_pos FROM c GROUP BY r) "
    f"SELECT regional_subset_id, n_pos, {R('area AS pr_auc', 'tpr AS tpr', 'fpr AS fpr')}, tpr >= 0.5 AS passes FROM a JOIN c0 ON r = regional_subset_id WHERE n_pos >= 10").replace("\nWITH c0", ",\nc0", 1))
def segment_gate(spark, sf):
    return rounded(evaluation.segments(_predicted(spark, sf), "score", "p", "label", "regional_subset_id"))


@query(store_sql(f"SELECT {R('(f1 * n1 + f0 * n0) / (n1 + n0) AS f1', '(p1 * n1 + p0 * n0) / (n1 + n0) AS weighted_precision', '(r1 * n1 + r0 * n0) / (n1 + n0) AS weighted_recall')} FROM (SELECT *, 2 * p1 * r1 / (p1 + r1) AS f1, 2 * p0 * r0 / (p0 + r0) AS f0 FROM (SELECT tp + fn AS n1, tn + fp AS n0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0 FROM ({_confusion_sql(f'(SELECT *, {_P} AS p FROM scored)')})))"))
def weighted_scores(spark, sf):
    return rounded(evaluation.weighted_f1(_predicted(spark, sf), "p", "label"))


@query(fused_sql(f"SELECT {KEYS}, CAST(coalesce(t_star_mo > 0.5 AND dist_to_grounding_line < 30000 AND bed < 0, false) AS INT) AS p FROM fused"))
def rule_classifier(spark, sf):
    return domain.fused(spark, sf).select("y", "x", "month_idx", evaluation.rule(F.col("t_star_mo"), F.col("dist_to_grounding_line"), F.col("bed")).alias("p"))


@query("SELECT s_suppkey, CASE WHEN a < 0.6 AND b < 0.6 THEN 'UNDERFITTING' WHEN a - b > 0.1 THEN 'OVERFITTING' WHEN a - b > 0.05 THEN 'MILD OVERFITTING' ELSE 'GOOD FIT' END AS fit FROM (SELECT s_suppkey, 0.5::DOUBLE + s_suppkey % 7 / 14 AS a, 0.5::DOUBLE + s_suppkey % 11 / 22 AS b FROM supplier)")
def fitting_diagnosis(spark, sf):
    a, b = 0.5 + F.col("s_suppkey") % 7 / 14, 0.5 + F.col("s_suppkey") % 11 / 22
    return table(spark, sf, "supplier").select("s_suppkey", evaluation.fit_label(a, b).alias("fit"))


@query("SELECT s_suppkey, tp, 1000 - tp AS fn, fp, 20000 - 1000 - fp AS tn FROM (SELECT *, CAST(round(tp / p) AS BIGINT) - tp AS fp FROM (SELECT s_suppkey, 0.3::DOUBLE + s_suppkey % 5 / 10 AS p, CAST(round((0.2::DOUBLE + s_suppkey % 7 / 10) * 1000) AS BIGINT) AS tp FROM supplier))")
def confusion_back_calc(spark, sf):
    p, r = 0.3 + F.col("s_suppkey") % 5 / 10, 0.2 + F.col("s_suppkey") % 7 / 10
    cells = evaluation.back_calculated(p, r, F.lit(1000).cast("long"), F.lit(20000).cast("long"))
    return table(spark, sf, "supplier").select("s_suppkey", *(c.alias(n) for n, c in cells.items()))


@query("SELECT unnest([" + ", ".join(f"'{c}'" for c in quality.STORE) + "]) AS \"column\", unnest([" + ", ".join(str(c != "h_surface_dynamic").lower() for c in quality.STORE) + "]) AS present, unnest([" + ", ".join(str(c in quality.CRITICAL).lower() for c in quality.STORE) + "]) AS critical")
def fused_schema(spark, sf):
    return quality.store_columns(domain.fused(spark, sf))


_HAVE = [c for c in quality.STORE if c not in ("h_surface_dynamic", "exact_time")]


@query(fused_sql(f"SELECT c AS \"column\", count(*) AS n, count(v) AS n_present, count(*) - count(v) AS n_null, round(100.0 * count(v) / count(*), 2)::DOUBLE AS pct FROM {_UNNEST(_HAVE, 'fused')} GROUP BY c"))
def fused_sparsity(spark, sf):
    return quality.sparsity(domain.fused(spark, sf), _HAVE)


@query(fused_sql(f"SELECT {R('min(lwe_fused) AS min_lwe_fused', 'max(lwe_fused) AS max_lwe_fused', 'min(lwe_mo) AS min_lwe_mo', 'max(lwe_mo) AS max_lwe_mo', 'avg(lwe_fused) AS mean_lwe_fused', 'quantile_cont(lwe_fused, 0.01) AS p_low', 'quantile_cont(lwe_fused, 0.99) AS p_high', 'greatest(abs(min(lwe_fused)), abs(max(lwe_fused))) / greatest(abs(min(lwe_mo)), abs(max(lwe_mo))) AS amplification')} FROM fused WHERE lwe_fused IS NOT NULL"))
def fused_amplification(spark, sf):
    return rounded(quality.amplification(domain.fused(spark, sf)))


@query(base_sql(f"SELECT 'mask_values' AS \"check\", count(*) FILTER (WHERE mask NOT IN (1, 3)) = 0 AS passed, count(*) FILTER (WHERE mask NOT IN (1, 3))::DOUBLE AS value FROM static UNION ALL SELECT 'freezing_above_0', 100.0 * count(*) FILTER (WHERE T_f > 0) / count(T_f) < 5, {R('100.0 * count(*) FILTER (WHERE T_f > 0) / count(T_f) AS v')} FROM ocean UNION ALL SELECT 'driving_above_0', NULL, {R('100.0 * count(*) FILTER (WHERE T_star > 0) / count(T_star) AS v')} FROM ocean"))
def mask_and_share_checks(spark, sf):
    ocean = quality.share_checks(domain.ocean(spark, sf), freezing="T_f", driving="T_star")
    return rounded(quality.share_checks(domain.static(spark, sf), mask="mask").unionByName(ocean))


@query(base_sql("SELECT 'steep_slope' AS \"check\", CASE WHEN max(bed_slope) <= 5 THEN 'pass' ELSE 'warn' END AS state, max(bed_slope)::DOUBLE AS value FROM static UNION ALL SELECT 'near_grounding_line', CASE WHEN max(dist_to_grounding_line) >= 1000 THEN 'pass' ELSE 'warn' END, max(dist_to_grounding_line)::DOUBLE FROM static"))
def raster_sanity(spark, sf):
    return quality.raster_sanity(domain.static(spark, sf), "bed_slope", "dist_to_grounding_line")


_BEDS = ["surface", "bed", "bed_slope"]


@query(base_sql(" UNION ALL ".join(f"SELECT 'static' AS \"table\", 'range_{c}' AS \"check\", CASE WHEN count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) = 0 THEN 'pass' ELSE '{'warn' if c == 'bed' else 'fail'}' END AS state FROM static" for c, (lo, hi) in quality.RANGES.items() if c in _BEDS) + " UNION ALL SELECT 'icesat', '*', 'skip'"))
def check_tracker(spark, sf):
    static = domain.static(spark, sf).select(*_BEDS)
    return quality.tracked({"static": quality.range_checks(static), "icesat": None}, warnings=["range_bed"])


@query(f"SELECT c AS \"column\", count(*) AS n, count(v) AS n_present, count(*) - count(v) AS n_null, round(100.0 * count(v) / count(*), 2)::DOUBLE AS pct FROM {_UNNEST(_LINE, 'lineitem')} GROUP BY c")
def line_completeness(spark, sf):
    return profile.completeness(table(spark, sf, "lineitem"), _LINE)
