"""Observation-anchored fusion of sparse and coarse series, and mass-conserving allocation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.keys import month_idx, round_key, whole
from gridloom.operators.windows import Series

#: Mean absolute change below which a coarse value is given to each cell as it is.
LEAST_MEAN = 1e-4


def keyed(df: DataFrame, drop: Sequence[str] = (), digits: int = 1) -> DataFrame:
    """Without some columns; coordinates rounded to be equal across tables, mascon ids as integers."""
    df = df.drop(*drop)
    new: dict[str, Column] = {c: round_key(c, digits) for c in ("y", "x") if c in df.columns}
    if "mascon_id" in df.columns:
        new["mascon_id"] = whole("mascon_id")
    return df.withColumns(new)


def monthly(df: DataFrame, keys: Sequence[str], stats: dict[str, Column], time: str = "time") -> DataFrame:
    """One row per key and calendar month."""
    return df.groupBy(*keys, month_idx(time).alias("month_idx")).agg(*(c.alias(n) for n, c in stats.items()))


def with_quarters(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Mean and deviation over three calendar months of each column, as `<name>_quarterly_avg` and `_std`."""
    s = Series(keys)
    new = {}
    for c, name in columns.items():
        new[f"{name}_quarterly_avg"], new[f"{name}_quarterly_std"] = s.mean_months(c), s.std_months(c)
    return df.withColumns(new)


def ocean_features(ocean: DataFrame) -> DataFrame:
    stats = {"thetao_mo": F.avg("thetao"), "t_star_mo": F.avg("T_star"), "so_mo": F.avg("so"), "t_f_mo": F.avg("T_f")}
    return with_quarters(monthly(ocean, ["y", "x"], stats), ["y", "x"], {"t_star_mo": "t_star", "thetao_mo": "thetao"})


def grace_features(grace: DataFrame) -> DataFrame:
    """Several coarse cells share a mascon; each month has its largest value."""
    rows = monthly(grace.where(F.col("mascon_id").isNotNull()), ["mascon_id"], {"lwe_mo": F.max("lwe_length")})
    return with_quarters(rows, ["mascon_id"], {"lwe_mo": "lwe"})


def allocated(change: Column, coarse: Column, n: Column, total: Column, least: float = LEAST_MEAN) -> Column:
    """A coarse value shared by absolute change, so the cells' sum is n times the value; evenly where nothing changes."""
    known = F.col("mascon_id").isNotNull() & change.isNotNull() & coarse.isNotNull() & (n > 0)
    by_change = (total / n > F.lit(least)) & (total > 0)
    return F.when(known, F.when(by_change, F.abs(change) / total * n * coarse).otherwise(coarse))


def fuse(icesat: DataFrame, static: DataFrame, ocean: DataFrame, grace: DataFrame) -> DataFrame:
    """Every observation, with what is known of its cell, its month in the ocean and its mascon's mass."""
    seen = icesat.withColumn("month_idx", month_idx("time")).withColumnRenamed("time", "exact_time")
    backbone = seen.join(static, ["y", "x"], "left")
    # of all columns only the change and the mascon go into the sums, so this is not the wide join again
    cells = static.select("y", "x", "mascon_id").where(F.col("mascon_id").isNotNull())
    sums = seen.select("y", "x", "month_idx", "delta_h").join(cells, ["y", "x"]).groupBy("mascon_id", "month_idx").agg(F.count("delta_h").alias("_n"), F.sum(F.abs("delta_h")).alias("_total"))
    rows = backbone.join(ocean_features(ocean), ["y", "x", "month_idx"], "left")
    rows = rows.join(grace_features(grace).join(sums, ["mascon_id", "month_idx"], "left"), ["mascon_id", "month_idx"], "left")
    return rows.withColumn("lwe_fused", allocated(F.col("delta_h"), F.col("lwe_mo"), F.coalesce("_n", F.lit(0)), F.col("_total"))).drop("_n", "_total")


def hit_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column how many rows have it, in percent, and whether fewer than half do; one scan."""
    n = F.count(F.lit(1))
    one = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), n.alias("n_rows"), F.count(c).alias("n_hit")) for c in columns)).alias("a"))
    rows = one.select(F.explode("a").alias("r")).select("r.*")
    pct = F.round(100.0 * F.col("n_hit") / F.nullif("n_rows", F.lit(0)), 1)
    return rows.withColumn("pct", pct).withColumn("low", F.coalesce(F.col("pct") < 50, F.lit(False)))
