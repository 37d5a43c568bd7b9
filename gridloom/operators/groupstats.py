"""Statistics of groups joined back to rows: aggregate first, so a group is a row a task.

Up to `FEW` groups are fetched once and joined as a broadcast of known size, so rows are not
shuffled by a handful of keys; more are joined by a shuffle, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Groups that are fetched and broadcast at most, a few numbers each.
FEW = 20_000


def small(table: DataFrame, most: int = FEW) -> DataFrame:
    """The rows of an aggregate, computed now and to be broadcast if there are at most so many; else as it was."""
    rows = table.limit(most + 1).collect()
    return table if len(rows) > most else F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: dict[str, Column], fit: Column | None = None, many: bool = False) -> DataFrame:
    """Each row with its group's statistics, of the rows where `fit` holds; a null key has none.

    many: there is a group a cell or so, which is not tried to fetch.
    """
    table = (df if fit is None else df.where(fit)).groupBy(*keys).agg(*(c.alias(n) for n, c in stats.items()))
    return df.join(table if many else small(table), list(keys), "left")


def group_zscore(df: DataFrame, keys: Sequence[str], c: str, out: str, floor: float = 1e-8) -> DataFrame:
    """(value - mean) / (deviation + floor) in its group."""
    df = with_group_stats(df, keys, {"_m": F.avg(c), "_s": F.stddev_samp(c)})
    return df.withColumn(out, (F.col(c) - F.col("_m")) / (F.col("_s") + F.lit(floor))).drop("_m", "_s")


def residuals(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fit: Column) -> DataFrame:
    """Each column minus its group's mean over the rows to learn from (0 for a group without any), as `<column>_resid`."""
    df = with_group_stats(df, keys, {f"_{c}": F.avg(c) for c in columns}, fit)
    return df.withColumns({f"{c}_resid": F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0.0)) for c in columns}).drop(*(f"_{c}" for c in columns))
