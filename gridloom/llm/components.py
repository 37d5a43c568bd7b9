"""Connected components of an edge table, by alternating large and small stars.

Every round is two aggregations and a join on the edges alone and ends in a table in the
shared folder; nothing is gathered on the driver but three counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import release, written


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of every node on an edge (a, b); root is the smallest node of its component.

    Loops and repeated edges do not matter; no edge gives no row.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    while not _stars(e):
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least("v", F.min("u")).alias("least"))
        # large star: what is larger than v hangs on the least around v
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("least").alias("u")).where("u <> v").distinct()
        # small star: v and what is smaller hang on the least of it
        under = large.groupBy("v").agg(F.min("u").alias("least"))
        small = large.join(under, "v").select(F.explode(F.array(F.struct("v", F.col("least").alias("u")), F.struct(F.col("u").alias("v"), F.col("least").alias("u")))).alias("x")).select("x.*")
        before, e = e, written(small.where("u <> v").distinct())
        release(before)
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every v has one u and no u is a v."""
    rows = e.select(F.col("v").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(e.select(F.col("u").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    each = rows.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return each.where("below > 1 or (below > 0 and above > 0)").limit(1).count() == 0
