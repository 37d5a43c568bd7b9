"""Queries of decompositions, clusters and models; results of iterative fits have no SQL and are tested against numpy or bounds."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridloom.functions.keys import REGION_CODES, coded, cyclic_month
from gridloom.operators import evaluation, ml, sampling
from gridloom.plans import features
from gridloom.plans.domain import BOUNDS, fused, store_sql, table
from gridloom.plans.queries_fusion import labelled, store
from gridloom.plans.registry import R, query, rounded
from gridloom.sources.tables import kept_on_disk, union_by_name

NUMERIC = ["surface", "bed", "thickness", "bed_slope", "dist_to_ocean", "ice_draft", "delta_h", "ice_area", "t_star_mo", "so_mo"]


def _vectors(spark, sf):
    return ml.vectors(table(spark, sf, "embeddings"))


def _splits(spark, sf):
    rows = labelled(spark, sf).withColumn("split", sampling.split_of(bounds=BOUNDS)).where("split is not null")
    model = ml.preparation(NUMERIC, "dist_to_grounding_line", "regional_subset_id").fit(rows.where("split = 'train'"))
    return ml.prepared(model, rows).select("y", "x", "month_idx", "split", "regional_subset_id", "label", "dist_to_grounding_line", "delta_h", "features")


@query(store_sql(f"SELECT y, x, month_idx, CASE WHEN month_idx <= {BOUNDS[1]} THEN 'train' WHEN month_idx <= {BOUNDS[2]} THEN 'validation' ELSE 'test' END AS split, CAST({len(NUMERIC)} + 6 + (SELECT count(DISTINCT regional_subset_id) FROM labelled WHERE month_idx BETWEEN {BOUNDS[0]} AND {BOUNDS[1]}) AS INT) AS n_features FROM labelled WHERE month_idx >= {BOUNDS[0]} AND dist_to_grounding_line IS NOT NULL"))
def preprocess_vectors(spark, sf):
    rows = _splits(spark, sf)
    return rows.select("y", "x", "month_idx", "split", F.size(vector_to_array("features")).alias("n_features"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 5 > 0 THEN p_size END, (SELECT quantile_disc(p_size, 0.5) FROM part WHERE p_size % 5 > 0)) AS filled FROM part")
def exact_median_imputation(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 5 > 0, F.col("p_size")).cast("double").alias("filled"))
    return ml.imputed_exactly(rows, ["filled"]).select("p_partkey", F.col("filled").cast("int").alias("filled"))


@query()
def pca_variance(spark, sf):
    return rounded(ml.principal_components(_vectors(spark, sf), 15)[1])


@query()
def pca_columns(spark, sf):
    rows, _ = ml.principal_components(_vectors(spark, sf), 4)
    return rounded(ml.expanded(rows, "pcs", [f"pc{k}" for k in range(4)]), "vec_id", *(f"pc{k}" for k in range(4)))


@query()
def svd_singular_values(spark, sf):
    return rounded(ml.singular_values(_vectors(spark, sf), 15))


@query("SELECT p_partkey, [p_size::DOUBLE, p_size * p_size::DOUBLE, p_retailprice, p_size * p_retailprice, p_retailprice * p_retailprice] AS terms FROM part")
def polynomial_expansion(spark, sf):
    rows = ml.polynomial(table(spark, sf, "part"), ["p_size", "p_retailprice"])
    return rows.select("p_partkey", vector_to_array("polynomial").alias("terms"))


@query()
def kmeans_sweep(spark, sf):
    return rounded(ml.clusters(_vectors(spark, sf), (4, 6, 8, 10))[1])


@query()
def cluster_profile(spark, sf):
    rows, _ = ml.clusters(_vectors(spark, sf), (4,))
    return rounded(ml.cluster_profile(ml.with_cluster(rows), "label"))


@query()
def cluster_by_region(spark, sf):
    with kept_on_disk(_splits(spark, sf)) as rows:
        clustered, _ = ml.clusters(rows.where("split = 'train'"), (4,))
        out = ml.cluster_profile(clustered, "label", "regional_subset_id").collect()
    return rounded(spark.createDataFrame(out, "cluster int, regional_subset_id string, n long, pos_rate double"))


@query()
def gbt_eval(spark, sf):
    with kept_on_disk(_splits(spark, sf)) as rows:
        model = ml.classifier("gbt", "label", maxIter=10, maxDepth=4).fit(rows.where("split = 'train'"))
        parts = [ml.evaluated(model.transform(rows.where(F.col("split") == s)), "label", "gbt", s) for s in ("train", "validation", "test")]
    return rounded(union_by_name(parts))


@query()
def feature_importances(spark, sf):
    with kept_on_disk(_splits(spark, sf)) as rows:
        train = rows.where("split = 'train'")
        return rounded(ml.importance_table(ml.classifier("boosted", "label", maxIter=5, maxDepth=4).fit(train), train))


@query()
def tree_progression(spark, sf):
    out = []
    with kept_on_disk(_splits(spark, sf)) as rows:
        train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
        for kind, settings in (("tree", {"maxDepth": 4}), ("forest", {"numTrees": 10, "maxDepth": 4}), ("gbt", {"maxIter": 5, "maxDepth": 4})):
            out.append(ml.evaluated(ml.classifier(kind, "label", **settings).fit(train).transform(test), "label", kind, "test"))
    return rounded(union_by_name(out))


_BASES = {"forest": {"numTrees": 8, "maxDepth": 4}, "gbt": {"maxIter": 4, "maxDepth": 3}}


def _stack(spark, sf, **settings):
    rows = sampling.fold_of(_splits(spark, sf))
    context = {"region_cat_idx": coded("regional_subset_id", REGION_CODES, 6), **dict(zip(("sin_month", "cos_month"), cyclic_month("month_idx"), strict=True))}
    with kept_on_disk(rows.withColumns(context)) as rows:
        _, scored = ml.stacked(rows.where("split = 'train'"), rows.where("split = 'test'"), "label", "fold", **settings, **_BASES)
        return rounded(ml.evaluated(scored, "label", "stacked", "test"))


@query()
def stack_oof_lr(spark, sf):
    """The base models' scores alone."""
    return _stack(spark, sf)


@query()
def stack_pruned_lr(spark, sf):
    """The corrected stack: 8 inputs, regularised as the reference's first logistic model."""
    return _stack(spark, sf, pruned=True, meta_settings={"maxIter": 50, **ml.META_LOGISTIC["baseline"]})


@query()
def stack_boosted_meta(spark, sf):
    """A booster over the base models' scores and all features."""
    return _stack(spark, sf, extra=["features"], meta="gbt", meta_settings={"maxIter": 4, "maxDepth": 3})


@query()
def second_model(spark, sf):
    """The second model from end to end: 27 columns, scaled, 15 components, clusters, a booster on both."""
    label = features.LABEL
    rows = features.ml_ready(store(spark, sf)).withColumn("split", sampling.split_of(bounds=BOUNDS)).where("split is not null")
    rows, names = features.second_set(rows, F.col("split") == "train")
    rows = rows.select("split", label, *(F.col(c).cast("double").alias(c) for c in names))
    scale = ml.preparation(names, scaler="unit", out="scaled").fit(rows.where("split = 'train'"))
    with kept_on_disk(scale.transform(rows).select("split", label, "scaled")) as rows:
        train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
        pca = ml.PCA(k=15, inputCol="scaled", outputCol="features").fit(train)
        train, test = pca.transform(train), pca.transform(test)
        clusters = ml.KMeans(k=4, seed=42, maxIter=50, featuresCol="features", predictionCol="cluster").fit(train)
        train, test = (ml.with_cluster(clusters.transform(x)) for x in (train, test))
        model = ml.classifier("gbt", label, "features_clustered", maxIter=5, maxDepth=4).fit(train)
        return rounded(ml.evaluated(model.transform(test), label, "components_and_clusters", "test"))


def _mass_parts(spark, sf):
    rows = sampling.two_way(fused(spark, sf), ["lwe_fused", "t_star_mo"], first_test=BOUNDS[2])
    names = [c for c in ml.MASS_DRIVERS if c in rows.columns]
    model = ml.preparation(names, scaler="unit").fit(rows.where("split = 'train'"))
    return ml.prepared(model, rows).select("split", "lwe_fused", "features")


@query()
def regression_eval(spark, sf):
    """The fused mass by its physical drivers."""
    with kept_on_disk(_mass_parts(spark, sf)) as rows:
        return rounded(ml.regression(rows.where("split = 'train'"), rows.where("split = 'test'"), "lwe_fused", maxIter=5)[0])


@query()
def regression_importances(spark, sf):
    with kept_on_disk(_mass_parts(spark, sf)) as rows:
        return rounded(ml.regression(rows.where("split = 'train'"), rows.where("split = 'test'"), "lwe_fused", maxIter=5)[1])


@query(store_sql(f"SELECT {R('auc AS roc_auc', 'ap AS pr_auc')}, n_pos, n_neg FROM (SELECT CASE WHEN n_pos > 0 AND n_neg > 0 THEN (p1 / 2.0 * n1 + (p1 + p0 / 2.0) * n0) / (n_pos * n_neg) END AS auc, CASE WHEN n_pos > 0 AND n_neg > 0 THEN ((CASE WHEN p1 + n1 > 0 THEN p1 * p1 / (p1 + n1) ELSE 0 END) + p0 * n_pos / (n_pos + n_neg)) / n_pos END AS ap, n_pos, n_neg FROM (SELECT count(*) FILTER (WHERE p AND label = 1)::DOUBLE AS p1, count(*) FILTER (WHERE NOT p AND label = 1)::DOUBLE AS p0, count(*) FILTER (WHERE p AND label = 0)::DOUBLE AS n1, count(*) FILTER (WHERE NOT p AND label = 0)::DOUBLE AS n0, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg FROM (SELECT label, coalesce(t_star_mo > 0.5 AND dist_to_grounding_line < 30000 AND bed < 0, false) AS p FROM labelled)))"))
def rule_baseline_ranking(spark, sf):
    rows = labelled(spark, sf).withColumn("p", evaluation.rule(F.col("t_star_mo"), F.col("dist_to_grounding_line"), F.col("bed")))
    return rounded(evaluation.ranking(ml.rule_vectors(rows, "p").withColumn("score", F.col("p").cast("double")), "score", "label"))
