"""All queries of this package by name, with DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Added before rounding, so that sums of another order fall on the same side of a tie.
SETTLE = 2.5e-10


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def R(*columns: str) -> str:
    """SQL of columns rounded as `rounded` does: `name` or `expression AS name`."""
    parts = (c.rsplit(" AS ", 1) if " AS " in c else (c, c) for c in columns)
    return ", ".join(f"round({e} + {SETTLE}, 8) + 0 AS {n}" for e, n in parts)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns; floating ones to 8 digits, without a negative zero."""
    from pyspark.sql import functions as F

    kinds = dict(df.dtypes)
    return df.select(*((F.round(F.col(c) + F.lit(SETTLE), 8) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns or df.columns))


from gridloom.plans import queries_fusion, queries_ml, queries_profile, queries_raster, queries_sources  # noqa: E402, F401
