"""Vectors, decompositions, clusters and models on MLlib. Fitting is on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, Bucketizer, Imputer, MinMaxScaler, Normalizer, OneHotEncoder, PolynomialExpansion, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.profile import order_statistics

#: Edges of the distance buckets in metres.
DISTANCE_EDGES = [float("-inf"), 5_000.0, 20_000.0, 50_000.0, 100_000.0, float("inf")]


def preparation(numeric: Sequence[str], distance: str | None = None, category: str | None = None, scaler: str = "minmax", out: str = "features") -> Pipeline:
    """Median imputation, distance buckets and categories one-hot, one scaled vector; rows without a bucket are skipped."""
    filled = [f"{c}_filled" for c in numeric]
    stages: list = [Imputer(strategy="median", inputCols=list(numeric), outputCols=filled)]
    parts = list(filled)
    if distance:
        stages += [Bucketizer(splits=DISTANCE_EDGES, inputCol=distance, outputCol="_bucket", handleInvalid="keep"), OneHotEncoder(inputCol="_bucket", outputCol="_bucket_vec", handleInvalid="keep")]
        parts.append("_bucket_vec")
    if category:
        stages += [StringIndexer(inputCol=category, outputCol="_cat", handleInvalid="keep"), OneHotEncoder(inputCol="_cat", outputCol="_cat_vec", handleInvalid="keep")]
        parts.append("_cat_vec")
    stages.append(VectorAssembler(inputCols=parts, outputCol="_raw", handleInvalid="skip"))
    scale = {"minmax": MinMaxScaler(inputCol="_raw", outputCol=out), "standard": StandardScaler(inputCol="_raw", outputCol=out, withMean=True), "unit": StandardScaler(inputCol="_raw", outputCol=out, withMean=False), "norm": Normalizer(inputCol="_raw", outputCol=out, p=2.0)}
    return Pipeline(stages=[*stages, scale[scaler]])


def prepared(model: PipelineModel, df: DataFrame, out: str = "features") -> DataFrame:
    """The rows with their vector, which keeps the names of its entries through the scaling."""
    rows = model.transform(df)
    return rows.withMetadata(out, rows.schema["_raw"].metadata)


def imputed_exactly(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values by the exact lower median: MLlib's imputer approximates it."""
    middle = order_statistics(df, dict.fromkeys(columns, lambda n: [(n - 1) // 2]))
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(next(iter(middle[c].values()), None))) for c in columns})


def vectors(df: DataFrame, column: str = "embedding", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def expanded(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """A vector's entries as columns."""
    return df.withColumn("_a", vector_to_array(vector)).withColumns({n: F.col("_a")[k] for k, n in enumerate(names)}).drop("_a")


def principal_components(df: DataFrame, k: int, vector: str = "features") -> tuple[DataFrame, DataFrame]:
    """Rows with `pcs`, and per component its share of the variance and the sum so far."""
    model = PCA(k=k, inputCol=vector, outputCol="pcs").fit(df)
    shares, total, rows = model.explainedVariance.toArray(), 0.0, []
    for i, s in enumerate(shares):
        total += float(s)
        rows.append((i, float(s), total))
    return model.transform(df), df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double")


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    rows = VectorAssembler(inputCols=list(columns), outputCol="_p", handleInvalid="skip").transform(df)
    return PolynomialExpansion(degree=degree, inputCol="_p", outputCol="polynomial").transform(rows).drop("_p")


def singular_values(df: DataFrame, k: int, vector: str = "features") -> DataFrame:
    """Of the tall matrix of all rows, through its Gramian of columns."""
    values = np.linalg.eigvalsh(gramian(df, vector))[::-1][:k]
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(np.sqrt(np.maximum(values, 0.0)))], "component int, value double")


def gramian(df: DataFrame, vector: str = "features") -> np.ndarray:
    """Sums of products of all pairs of columns: each task multiplies its Arrow batches, the tasks' matrices are added by entry."""
    def run(batches):
        total = None
        for batch in batches:
            rows = batch.column("a")
            if len(rows):
                x = rows.flatten().to_numpy().reshape(len(rows), -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            at = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(at // len(total)), pa.array(at % len(total)), pa.array(total.ravel())], names=["i", "j", "v"])

    parts = df.select(vector_to_array(vector).alias("a")).mapInArrow(run, "i long, j long, v double")
    cells = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    n = max((r["i"] for r in cells), default=-1) + 1
    out = np.zeros((n, n))
    for r in cells:
        out[r["i"], r["j"]] = r["v"]
    return out


def clusters(df: DataFrame, ks: Sequence[int] = (4, 6, 8, 10), vector: str = "features", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows with `cluster` of the best k by silhouette, and the silhouettes."""
    evaluator, found = ClusteringEvaluator(featuresCol=vector, predictionCol="cluster", metricName="silhouette", distanceMeasure="squaredEuclidean"), []
    for k in ks:
        model = KMeans(k=k, seed=seed, maxIter=50, featuresCol=vector, predictionCol="cluster").fit(df)
        found.append((float(evaluator.evaluate(model.transform(df))), k, model))
    best = max(found, key=lambda x: (x[0], -x[1]))
    return best[2].transform(df), df.sparkSession.createDataFrame([(k, s, k == best[1]) for s, k, _ in found], "k int, silhouette double, best boolean")


def with_cluster(df: DataFrame, vector: str = "features", out: str = "features_clustered") -> DataFrame:
    return VectorAssembler(inputCols=[vector, "cluster"], outputCol=out, handleInvalid="skip").transform(df)


def cluster_profile(df: DataFrame, label: str, region: str | None = None) -> DataFrame:
    return df.groupBy("cluster", *([region] if region else [])).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("pos_rate"))


def classifier(kind: str, label: str, vector: str = "features", weight: str | None = None, seed: int = 42, **settings):
    """boosted (xgboost's where it is installed, else MLlib's), forest, tree or logistic."""
    if kind == "boosted":
        try:
            from xgboost.spark import SparkXGBClassifier

            return SparkXGBClassifier(features_col=vector, label_col=label, weight_col=weight, random_state=seed, **settings)
        except ImportError:
            kind = "gbt"
    kinds = {"gbt": GBTClassifier, "forest": RandomForestClassifier, "tree": DecisionTreeClassifier, "logistic": LogisticRegression}
    extra = {"weightCol": weight} if weight else {}
    if kind != "logistic":
        extra["seed"] = seed
    return kinds[kind](featuresCol=vector, labelCol=label, **extra, **settings)


def scored(model, df: DataFrame, out: str = "score") -> DataFrame:
    """Rows with the probability of label 1."""
    return model.transform(df).withColumn(out, vector_to_array("probability")[1])


def evaluated(df: DataFrame, label: str, name: str, split: str) -> DataFrame:
    """One row of metrics; areas are null where only one class is there."""
    from gridloom.operators.evaluation import weighted_f1

    ends = df.agg(F.min(label), F.max(label)).first()
    areas = [None, None]
    if ends[0] != ends[1]:
        areas = [float(BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", metricName=m).evaluate(df)) for m in ("areaUnderROC", "areaUnderPR")]
    rest = weighted_f1(df, "prediction", label).first()
    return df.sparkSession.createDataFrame([(name, split, *areas, *rest)], "model string, split string, roc_auc double, pr_auc double, f1 double, weighted_precision double, weighted_recall double")


def importances(model, names: Sequence[str], n: int = 10) -> list[tuple[str, float]]:
    values = model.featureImportances.toArray()
    return sorted(((names[k], float(v)) for k, v in enumerate(values)), key=lambda x: (-x[1], x[0]))[:n]


#: Columns beside the base models' results that the corrected stack sees, and its two logistic models.
META_CONTEXT = ["region_cat_idx", "sin_month", "cos_month", "dist_to_grounding_line", "delta_h"]
META_LOGISTIC = {"baseline": {"regParam": 0.01, "elasticNetParam": 0.0}, "tuned": {"regParam": 0.1, "elasticNetParam": 0.5}}


def importance_table(model, df: DataFrame, vector: str = "features", n: int = 10) -> DataFrame:
    """The n most important entries of a vector, by the names its assembly left in the column's metadata."""
    about = df.schema[vector].metadata.get("ml_attr", {})
    names = {a["idx"]: a.get("name", str(a["idx"])) for kind in about.get("attrs", {}).values() for a in kind}
    rows = importances(model, [names.get(k, str(k)) for k in range(model.numFeatures)], n)
    return df.sparkSession.createDataFrame([(k, name, value) for k, (name, value) in enumerate(rows)], "rank int, feature string, importance double")


def meta_columns(df: DataFrame, context: Sequence[str] = META_CONTEXT) -> tuple[DataFrame, list[str]]:
    """The forest's probability, the booster's decision, whether both decide alike, and the context there is, 0 where missing: the 8 inputs of the corrected stack."""
    near = {"base_agreement": (F.col("decision_forest") == F.col("decision_gbt")).cast("double"), **{f"{c}_meta": F.coalesce(F.col(c), F.lit(0.0)).cast("double") for c in context if c in df.columns}}
    return df.withColumns(near), ["score_forest", "decision_gbt", *near]


def stacked(
    train: DataFrame, test: DataFrame, label: str, fold: str, vector: str = "features", bases: Sequence[str] = ("forest", "gbt"), extra: Sequence[str] = (), meta: str = "logistic", pruned: bool = False, context: Sequence[str] = META_CONTEXT, meta_settings: dict | None = None, **settings
) -> tuple[PipelineModel, DataFrame]:
    """Base models learn on each half and score the other; a further model learns on what they say; bases of all rows score the test.

    pruned: it sees `meta_columns`; else the bases' scores and `extra`, which may name the whole feature vector.
    """
    def layer(fit: DataFrame, on: DataFrame) -> DataFrame:
        for b in bases:
            model = classifier(b, label, vector, **settings.get(b, {})).fit(fit)
            on = scored(model, on, f"score_{b}").withColumn(f"decision_{b}", F.col("prediction")).drop("rawPrediction", "probability", "prediction")
        return on

    halves = [v[0] for v in train.select(fold).distinct().orderBy(fold).collect()]
    out_of_fold = None
    for h in halves:
        part = layer(train.where(F.col(fold) != h), train.where(F.col(fold) == h))
        out_of_fold = part if out_of_fold is None else out_of_fold.unionByName(part)
    seen = [*(f"score_{b}" for b in bases), *extra]
    on = layer(train, test)
    if pruned:
        (out_of_fold, seen), (on, _) = meta_columns(out_of_fold, context), meta_columns(on, context)
    assemble = VectorAssembler(inputCols=seen, outputCol="_meta", handleInvalid="skip")
    model = Pipeline(stages=[assemble, classifier(meta, label, "_meta", **(meta_settings or {}))]).fit(out_of_fold)
    return model, model.transform(on)


#: What the regression on the fused mass column sees.
MASS_DRIVERS = [
    "surface", "bed", "thickness", "bed_slope", "dist_to_grounding_line", "clamped_depth", "dist_to_ocean", "ice_draft",
    "thetao_mo", "t_star_mo", "so_mo", "t_f_mo", "t_star_quarterly_avg", "t_star_quarterly_std", "thetao_quarterly_avg", "thetao_quarterly_std",
    "lwe_mo", "lwe_quarterly_avg", "lwe_quarterly_std",
]


def regression(train: DataFrame, test: DataFrame, label: str, vector: str = "features", seed: int = 42, **settings) -> tuple[DataFrame, DataFrame]:
    """Errors on the test rows, and the most important inputs."""
    model = GBTRegressor(featuresCol=vector, labelCol=label, seed=seed, **settings).fit(train)
    rows = model.transform(test)
    values = {m: float(RegressionEvaluator(labelCol=label, metricName=m).evaluate(rows)) for m in ("rmse", "mae", "r2")}
    return train.sparkSession.createDataFrame([tuple(values.values())], "rmse double, mae double, r2 double"), importance_table(model, train, vector)


def rule_vectors(df: DataFrame, prediction: str) -> DataFrame:
    """A rule's 0 or 1 as raw prediction (-p, p)."""
    p = F.col(prediction).cast("double")
    return df.withColumn("rawPrediction", array_to_vector(F.array(-p, p)))
