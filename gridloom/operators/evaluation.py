"""Evaluation of scored rows: confusion, threshold sweeps, ranking metrics, segments.

Sweeps and curves come from one aggregation over scores, never from collected rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Thresholds of the F1 sweep; region thresholds that replace a global one.
F1_THRESHOLDS = (0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50)
REGION_THRESHOLDS = {"amundsen_sea": 0.35}


def cells(prediction: Column, label: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if((prediction == 1) & (label == 1)), "fp": F.count_if((prediction == 1) & (label == 0)),
        "fn": F.count_if((prediction == 0) & (label == 1)), "tn": F.count_if((prediction == 0) & (label == 0)),
    }


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, prediction: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    out = df.groupBy(*by).agg(*(c.alias(n) for n, c in cells(F.col(prediction), F.col(label)).items()))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fnr": ratio(fn, tp + fn), "fpr": ratio(fp, fp + tn)})


def error_type(prediction: Column, label: Column) -> Column:
    return F.when((prediction == 1) & (label == 1), "TP").when(prediction == 1, "FP").when(label == 1, "FN").otherwise("TN")


def sweep(df: DataFrame, score: str, label: str, thresholds: Sequence[float] = F1_THRESHOLDS, beta: float = 1.0) -> DataFrame:
    """Per threshold counts, precision, recall and F-beta: one pass over scores cut to the thresholds' steps."""
    steps = sorted(thresholds)
    reached = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in steps), F.lit(0))
    bins = df.groupBy(reached.alias("k")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    one = bins.agg(F.collect_list(F.struct("k", "pos", "neg")).alias("b"), F.sum("pos").alias("all_pos"))
    count = lambda c, k: F.aggregate(F.filter("b", lambda x: x["k"] > k), F.lit(0).cast("long"), lambda s, x: s + x[c])
    rows = one.select("b", "all_pos", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("threshold")) for k, t in enumerate(steps)))).alias("t"))
    rows = rows.select(F.col("t.threshold").alias("threshold"), count("pos", F.col("t.k")).alias("tp"), count("neg", F.col("t.k")).alias("fp"), "all_pos")
    rows = rows.withColumn("fn", F.col("all_pos") - F.col("tp")).drop("all_pos")
    rows = rows.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    b = beta * beta
    return rows.withColumn("f", ratio((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall")))


def best_threshold(swept: DataFrame, fallback: float = 0.5) -> DataFrame:
    """The threshold of the highest F, the lowest among equals; the fallback where none is above 0."""
    best = swept.where("f > 0").agg(F.max_by("threshold", F.struct("f", -F.col("threshold"))).alias("threshold"), F.max("f").alias("f"))
    return best.select(F.coalesce("threshold", F.lit(fallback)).alias("threshold"), F.coalesce("f", F.lit(0.0)).alias("f"))


def predicted(score: Column, threshold: float, region: Column | None = None, overrides: dict[str, float] | None = None) -> Column:
    """1 from the threshold on, or from the region's own."""
    limit = F.lit(float(threshold))
    for name, t in (REGION_THRESHOLDS if overrides is None else overrides).items() if region is not None else ():
        limit = F.when(region == name, F.lit(t)).otherwise(limit)
    return (score >= limit).cast("int")


def ranking(df: DataFrame, score: str, label: str, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """ROC-AUC and PR-AUC (step interpolation): windows over distinct scores, not over rows; null for one class. digits: of scores rounded first, where there are very many."""
    rows = df.groupBy(*by, (F.col(score) if digits is None else F.round(score, digits)).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("s"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"tp": F.sum("p").over(upto), "fp": F.sum("n").over(upto)})
    area = F.sum((F.col("tp") - F.col("p") / 2.0) * F.col("n"))
    steps = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    pos, neg = F.sum("p"), F.sum("n")
    both = (pos > 0) & (neg > 0)
    return rows.groupBy(*by).agg(F.when(both, area / (pos * neg)).alias("roc_auc"), F.when(both, steps / pos).alias("pr_auc"), pos.alias("n_pos"), neg.alias("n_neg"))


def weighted_f1(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """F1, precision and recall of both classes, weighted by their size."""
    c = df.agg(*(x.alias(n) for n, x in cells(F.col(prediction), F.col(label)).items()))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n1, n0 = tp + fn, tn + fp
    mean = lambda a, b: (a * n1 + b * n0) / (n1 + n0)
    f = lambda p, r: ratio(2 * p * r, p + r)
    p1, r1, p0, r0 = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fn), ratio(tn, tn + fp)
    return c.select(mean(f(p1, r1), f(p0, r0)).alias("f1"), mean(p1, p0).alias("weighted_precision"), mean(r1, r0).alias("weighted_recall"))


def segments(df: DataFrame, score: str, prediction: str, label: str, region: str, least_pos: int = 10, gate: float = 0.5) -> DataFrame:
    """Per region ranking and rates, for regions with enough positives, and whether the true positive rate passes."""
    rates = confusion(df, prediction, label, [region])
    curves = ranking(df, score, label, [region]).select(region, "pr_auc", "n_pos")
    return curves.join(rates, region).where(F.col("n_pos") >= least_pos).select(region, "n_pos", "pr_auc", F.col("recall").alias("tpr"), "fpr", (F.col("recall") >= gate).alias("passes"))


def region_summary(df: DataFrame, score: str, label: str, region: str) -> DataFrame:
    return df.groupBy(region).agg(F.avg(score).alias("mean_prediction"), F.avg(label).alias("true_rate"), F.count(F.lit(1)).alias("n"))


def rule(t_star: Column, to_grounding_line: Column, bed: Column) -> Column:
    """1 where warm water, a near grounding line and a bed below the sea meet; unknown counts as no."""
    return F.coalesce((t_star > 0.5) & (to_grounding_line < 30_000) & (bed < 0), F.lit(False)).cast("int")


def fit_label(train: Column, validation: Column) -> Column:
    """What the gap between training and validation says."""
    gap = train - validation
    return F.when((train < 0.60) & (validation < 0.60), "UNDERFITTING").when(gap > 0.10, "OVERFITTING").when(gap > 0.05, "MILD OVERFITTING").otherwise("GOOD FIT")


def back_calculated(precision: Column, recall: Column, n_pos: Column, n: Column) -> dict[str, Column]:
    """The confusion cells that rates and totals imply."""
    tp = F.round(recall * n_pos).cast("long")
    fp = F.when(precision > 0, F.round(tp / precision).cast("long") - tp).otherwise(F.lit(0)).cast("long")
    return {"tp": tp, "fn": n_pos - tp, "fp": fp, "tn": n - n_pos - fp}
