"""Splits, reproducible sampling, rebalancing and weights.

Samples are drawn by a hash of key columns, so they do not depend on partitions or order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.keys import NEGATIVES_PER_POSITIVE, REGION_WEIGHTS, coded
from gridloom.operators.groupstats import small

#: First and last month of training, last of validation.
TRAIN_FROM, TRAIN_TO, VALIDATION_TO = 24244, 24276, 24286
SECOND_TEST_FROM = 24289


def draw(keys: Sequence[str], seed: int = 42) -> Column:
    """A number in [0, 1) fixed by the keys and the seed."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def sample(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    return df.where(draw(keys, seed) < F.lit(fraction))


def split_of(index: Column | str = "month_idx", bounds: tuple[int, int, int] = (TRAIN_FROM, TRAIN_TO, VALIDATION_TO)) -> Column:
    """train, validation or test by month; null before training begins."""
    c = F.col(index) if isinstance(index, str) else index
    return F.when(c < bounds[0], None).when(c <= bounds[1], "train").when(c <= bounds[2], "validation").otherwise("test")


def split_summary(df: DataFrame, label: str, bounds: tuple[int, int, int] = (TRAIN_FROM, TRAIN_TO, VALIDATION_TO)) -> DataFrame:
    """Rows, positives and their share of each split, in one pass."""
    rows = df.where(F.col(label).isNotNull()).withColumn("split", split_of(bounds=bounds)).where("split is not null")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("n_pos"), F.avg(label).alias("pos_rate"))


def fold_of(df: DataFrame, order: str = "month_idx") -> DataFrame:
    """Halves in time: fold `a` up to the middle month, `b` after it."""
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).select(F.floor((F.col("lo") + F.col("hi")) / 2).cast("int").alias("mid")).first()
    return df.withColumn("fold", F.when(F.col(order) <= F.lit(ends["mid"]), "a").otherwise("b"))


def undersampled(df: DataFrame, label: str, region: str, draw_of: Column, ratios: dict[str, int] | None = None, fallback: int = 10) -> DataFrame:
    """All positives, and as many negatives per positive as the region's ratio; a region without a positive goes.

    One aggregation for all regions; the counts come back as one row a region.
    """
    positive = F.col(label) == 1
    counts = df.groupBy(region).agg(F.count_if(positive).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    want = F.col("_pos") * coded(region, ratios or NEGATIVES_PER_POSITIVE, fallback)
    counts = counts.where("_pos > 0").select(region, F.least(F.lit(1.0), want / F.greatest("_neg", F.lit(1))).alias("_share"))
    return df.join(small(counts), region).where(positive | ((F.col(label) == 0) & (draw_of < F.col("_share")))).drop("_share")


def class_ratios(df: DataFrame, label: str, region: str, fit: Column) -> DataFrame:
    """Negatives per positive of each region in training rows; 1 without a positive."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.where(fit).groupBy(region).agg(neg.alias("neg_count"), pos.alias("pos_count"), F.when(pos > 0, neg / pos).otherwise(F.lit(1.0)).alias("class_ratio"))


def weighted(df: DataFrame, label: str, region: str, fit: Column, weights: dict[str, float] | None = None, out: str = "weightCol") -> DataFrame:
    """Region weight times class balance, so that the mean over training rows is 1."""
    rows = df.join(small(class_ratios(df, label, region, fit).select(region, "class_ratio")), region, "left")
    raw = coded(region, weights or REGION_WEIGHTS, 1.0) * F.when(F.col(label) == 1, F.col("class_ratio")).otherwise(F.lit(1.0))
    rows = rows.withColumn("_raw", raw).drop("class_ratio")
    mean = rows.where(fit).agg(F.avg("_raw")).first()[0]
    return rows.withColumn(out, F.col("_raw") / F.lit(mean)).drop("_raw")


def reweighted(df: DataFrame, region: str, weights: dict[str, float], out: str = "weightCol") -> DataFrame:
    """A weight times a second one of the region; 1 for other regions."""
    return df.withColumn(out, F.col(out) * coded(region, weights, 1.0))


def two_way(df: DataFrame, needed: Sequence[str], index: str = "month_idx", first_test: int = SECOND_TEST_FROM) -> DataFrame:
    """Rows that have what is needed, `train` before a month and `test` from it on."""
    have = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in needed))
    return df.where(have).withColumn("split", F.when(F.col(index) < first_test, "train").otherwise("test"))


def random_parts(df: DataFrame, shares: Sequence[float], keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Each row with the number of its part, drawn by a hash of keys so that the parts' sizes are about the shares."""
    total, upto, part = sum(shares), 0.0, F.lit(len(shares) - 1)
    edges = []
    for s in shares[:-1]:
        upto += s / total
        edges.append(upto)
    at = draw(keys, seed)
    for k in range(len(edges) - 1, -1, -1):
        part = F.when(at < edges[k], F.lit(k)).otherwise(part)
    return df.withColumn("part", part)


def scale_pos_weight(df: DataFrame, label: str, most: float = 15.0) -> DataFrame:
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(neg.alias("neg"), pos.alias("pos"), F.least(neg / F.greatest(pos, F.lit(1)), F.lit(most)).alias("scale_pos_weight"))


def first_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in a total order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
