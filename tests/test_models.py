"""Decompositions, clusters, models and sinks against numpy, or within bounds that chance does not reach."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridloom.operators import evaluation, groupstats, ml, profile, quality, raster, sampling
from gridloom.plans import features
from gridloom.plans.registry import QUERIES
from gridloom.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def matrix(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["embedding"] for r in rows], float)


def test_singular_values(spark, matrix):
    got = [r["value"] for r in QUERIES["svd_singular_values"](spark, SF).orderBy("component").collect()]
    assert got == pytest.approx(np.linalg.svd(matrix, compute_uv=False)[:15].tolist(), rel=1e-6)


def test_principal_components(spark, matrix):
    got = QUERIES["pca_variance"](spark, SF).orderBy("component").collect()
    values = np.linalg.eigvalsh(np.cov(matrix.T))[::-1]
    assert [r["share"] for r in got] == pytest.approx((values[:15] / values.sum()).tolist(), rel=1e-6)
    assert got[-1]["cumulative"] == pytest.approx(values[:15].sum() / values.sum(), rel=1e-6)
    columns = np.array([[r[f"pc{k}"] for k in range(4)] for r in QUERIES["pca_columns"](spark, SF).orderBy("vec_id").collect()])
    _, vectors = np.linalg.eigh(np.cov(matrix.T))
    assert np.abs(columns) == pytest.approx(np.abs(matrix @ vectors[:, ::-1][:, :4]), abs=1e-5)


def test_silhouettes(spark, matrix):
    rows, found = ml.clusters(ml.vectors(spark.read.parquet(f"{SF}/embeddings.parquet")), (4, 6))
    assert [r["k"] for r in found.where("best").collect()] == [max(found.collect(), key=lambda r: r["silhouette"])["k"]]
    best = found.where("best").first()
    of = np.array([r["cluster"] for r in rows.orderBy("vec_id").collect()])
    squares = ((matrix[:, None] - matrix[None]) ** 2).sum(axis=2)
    scores = []
    for i, c in enumerate(of):
        own = of == c
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = squares[i, own].sum() / (own.sum() - 1)
        b = min(squares[i, of == d].mean() for d in set(of.tolist()) - {c})
        scores.append((b - a) / max(a, b))
    assert best["silhouette"] == pytest.approx(np.mean(scores), abs=1e-6)


def test_cluster_counts(spark):
    by_region = QUERIES["cluster_by_region"](spark, SF).collect()
    assert sum(r["n"] for r in by_region) > 100 and all(0 <= r["pos_rate"] <= 1 for r in by_region)
    whole = QUERIES["cluster_profile"](spark, SF).collect()
    assert sum(r["n"] for r in whole) == spark.read.parquet(f"{SF}/embeddings.parquet").count()


@pytest.mark.parametrize("name", ["gbt_eval", "tree_progression", "stack_oof_lr", "stack_pruned_lr", "stack_boosted_meta", "second_model"])
def test_models_beat_chance(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    for r in rows:
        assert r["model"] == "tree" or r["roc_auc"] > 0.6
        assert 0 < r["f1"] <= 1


def test_regression_explains_and_names_its_inputs(spark):
    (r,) = QUERIES["regression_eval"](spark, SF).collect()
    assert r["r2"] > 0.3 and 0 < r["mae"] <= r["rmse"]
    top = [x["feature"] for x in QUERIES["regression_importances"](spark, SF).orderBy("rank").collect()]
    assert top[0].startswith("lwe_") and len(top) == 10
    assert all(0 <= x["importance"] <= 1 and not x["feature"].isdigit() for x in QUERIES["feature_importances"](spark, SF).collect())


def test_meta_columns(spark):
    rows = spark.createDataFrame([(0.7, 1.0, 1.0, None, 0.5), (0.2, 0.0, 1.0, 3.0, None)], "score_forest double, decision_forest double, decision_gbt double, sin_month double, delta_h double")
    out, names = ml.meta_columns(rows)
    assert names == ["score_forest", "decision_gbt", "base_agreement", "sin_month_meta", "delta_h_meta"]
    assert [tuple(r) for r in out.select(*names).collect()] == [(0.7, 1.0, 1.0, 0.0, 0.5), (0.2, 1.0, 0.0, 3.0, 0.0)]


def test_order_statistics(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.standard_normal(3000) * 10 ** rng.integers(-9, 9, 3000).astype(float), np.full(500, 7.0)])
    rows = spark.createDataFrame([(float(v), None if k % 3 else float(k)) for k, v in enumerate(values)] + [(float("nan"), None)], "a double, b double")
    want = np.sort(values)
    ranks = [0, 1, 17, 1750, 2900, 3498, 3499]
    got = profile.order_statistics(rows, {"a": lambda n: ranks, "b": lambda n: [n // 2]})
    assert got["a"] == {k: want[k] for k in ranks}
    b = [float(k) for k in range(len(values)) if k % 3 == 0]
    assert got["b"] == {len(b) // 2: b[len(b) // 2]}
    assert profile.order_statistics(rows.limit(0), {"a": lambda n: [0]}) == {"a": {}}


def test_ranking_does_not_round_scores(spark):
    rows = spark.createDataFrame([(0.50001, 1), (0.50002, 0), (0.50003, 1), (0.1, 0)], "s double, y int")
    (r,) = evaluation.ranking(rows, "s", "y").collect()
    assert r["roc_auc"] == pytest.approx(0.75)
    assert evaluation.ranking(rows, "s", "y", digits=4).first()["roc_auc"] == pytest.approx(0.75 + 0.0, abs=0.01)


def test_few_groups_are_broadcast_and_many_are_not(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 6).alias("g"), F.col("id").alias("v"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = groupstats.with_group_stats(rows, ["g"], {"m": F.avg("v")})
    assert "BroadcastHashJoin" in plan(few) and "SortMergeJoin" not in plan(few)
    assert few.where("id = 7").first()["m"] == pytest.approx(np.mean(range(1, 1000, 6)))
    old, groupstats.FEW = groupstats.FEW, 3
    try:
        assert groupstats.small(rows.groupBy("g").count(), 3).count() == 6
    finally:
        groupstats.FEW = old


def test_firewall(spark):
    with pytest.raises(ValueError, match="lwe_fused"):
        features.firewalled(spark.range(1).withColumn("lwe_fused", F.lit(1.0)))


def test_second_set_is_of_27_columns(spark):
    assert len(QUERIES["second_feature_set"](spark, SF).columns) == 3 + 27


def test_tracker_codes(spark):
    rows = spark.createDataFrame([("a", True), ("b", False)], "check string, passed boolean")
    assert quality.tracked_code(quality.tracked({"t": rows, "u": None})) == 2
    assert quality.tracked_code(quality.tracked({"t": rows}, warnings=["b"])) == 1
    assert quality.tracked_code(quality.tracked({"t": rows.where("passed")})) == 0
    assert {tuple(r) for r in quality.tracked({"t": rows, "u": None}).collect()} == {("t", "a", "pass"), ("t", "b", "fail"), ("u", "*", "skip")}


def test_raster_sanity_skips_what_is_missing(spark):
    rows = spark.createDataFrame([(6.0,)], "slope double")
    assert {(r["check"], r["state"]) for r in quality.raster_sanity(rows, "slope", "distance").collect()} == {("steep_slope", "warn"), ("near_grounding_line", "skip")}


def test_parts_of_a_random_split(spark):
    rows = spark.range(4000)
    sizes = {r["part"]: r["count"] for r in sampling.random_parts(rows, [0.5, 0.3, 0.2], ["id"]).groupBy("part").count().collect()}
    assert sizes == sampling.random_parts(rows.repartition(7), [0.5, 0.3, 0.2], ["id"]).groupBy("part").count().rdd.collectAsMap()
    assert [abs(sizes[k] / 4000 - s) < 0.04 for k, s in enumerate((0.5, 0.3, 0.2))] == [True] * 3


def test_nearest_point_in_dense_places(spark):
    rng = np.random.default_rng(8)
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(np.concatenate([rng.normal((40, 8), 0.01, (400, 2)), rng.uniform((-90, -180), (90, 180), (60, 2))]))]
    queries = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform((-90, -180), (90, 180), (30, 2)))]
    got = {r["q"]: r["p"] for r in raster.nearest_point(spark.createDataFrame(queries, "q int, lat double, lon double"), spark.createDataFrame(points, "p int, lat double, lon double"), "q", "p").collect()}
    at = lambda a, b: np.array([np.cos(np.radians(a)) * np.cos(np.radians(b)), np.cos(np.radians(a)) * np.sin(np.radians(b)), np.sin(np.radians(a))])
    for k, a, b in queries:
        assert got[k] == min(points, key=lambda p: float(((at(p[1], p[2]) - at(a, b)) ** 2).sum()))[0]  # noqa: B023


def test_rebalanced_partitions(spark, tmp_path):
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("g"))
    tables.save(rows, str(tmp_path / "t"), by=["g"])
    assert tables.scan(spark, str(tmp_path / "t")).groupBy("g").count().count() == 3
    assert tables.census(spark, str(tmp_path / "t")).count() == 3


def test_vectors_of_arrays(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "a array<double>").select(array_to_vector("a").alias("features"))
    assert ml.gramian(rows).tolist() == [[10.0, 14.0], [14.0, 20.0]]
