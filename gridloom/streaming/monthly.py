"""Monthly statistics as observations arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.keys import month_idx


def monthly_stream(rows: DataFrame, keys: Sequence[str], value: str, time: str = "time") -> DataFrame:
    """Mean and count per key and calendar month, for complete or update output; the state is a row a key and month."""
    return rows.groupBy(*keys, month_idx(time).alias("month_idx")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
