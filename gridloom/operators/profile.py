"""One-pass profiles of tables: long results, one scan for any number of columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType


def long_stats(df: DataFrame, columns: Sequence[str], stats: dict[str, Callable[[str], Column]]) -> DataFrame:
    """One row per column with its statistics, from a single aggregation."""
    one = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), *(f(c).alias(n) for n, f in stats.items())) for c in columns)).alias("a"))
    return one.select(F.explode("a").alias("r")).select("r.*")


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    n = F.count(F.lit(1))
    out = long_stats(df, columns or df.columns, {"n": lambda _: n, "n_present": lambda c: F.count(F.col(c)), "n_null": lambda c: n - F.count(F.col(c))})
    return out.withColumn("pct", F.round(100.0 * F.col("n_present") / F.nullif("n", F.lit(0)), 2))


def missing_ratio(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of values that are null or, in float columns, NaN."""
    kinds = {f.name: f.dataType for f in df.schema}
    odd = lambda c: F.col(c).isNull() | (F.isnan(c) if isinstance(kinds[c], (DoubleType, FloatType)) else F.lit(False))
    return long_stats(df, columns or df.columns, {"ratio": lambda c: F.count_if(odd(c)) / F.nullif(F.count(F.lit(1)), F.lit(0))})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def range_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    value = lambda f: lambda c: f(F.col(c).cast("double"))
    return long_stats(df, columns or numeric_columns(df), {"n": lambda c: F.count(F.col(c)), "min": value(F.min), "max": value(F.max), "mean": value(F.avg), "stddev": value(F.stddev_samp)})


def distinct_counts(df: DataFrame, **sets: Sequence[str]) -> DataFrame:
    return df.agg(*(F.count_distinct(*(F.col(c) for c in cols)).alias(name) for name, cols in sets.items()))


def histogram(df: DataFrame, c: str, bins: int, group: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed, empty ones with 0: two scans, no row leaves its task but counts."""
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    step = (float(hi) - float(lo)) / bins or 1.0
    at = F.least(F.floor((F.col(c) - F.lit(float(lo))) / F.lit(step)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(c).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda k: F.lit(float(lo)) + k * F.lit(step)
    return every.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def mean_by_cell(df: DataFrame, x: str, y: str, value: str, width: float, height: float) -> DataFrame:
    """Mean and count on rectangles of the plane."""
    return df.groupBy(F.floor(F.col(x) / F.lit(width)).alias("cx"), F.floor(F.col(y) / F.lit(height)).alias("cy")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def hexbin(df: DataFrame, x: str, y: str, value: str, size: float) -> DataFrame:
    """Mean on a hexagonal lattice: of two offset rectangular lattices the nearer centre."""
    u, v = F.col(x) / F.lit(size), F.col(y) / F.lit(size * 3**0.5)
    near = lambda a, b, o: F.pow(a - F.round(a - o) - o, 2) + 3 * F.pow(b - F.round(b - o) - o, 2)
    first = near(u, v, F.lit(0.0)) <= near(u, v, F.lit(0.5))
    centre = lambda a: F.when(first, F.round(a)).otherwise(F.round(a - F.lit(0.5)) + F.lit(0.5))
    return df.groupBy((centre(u) * F.lit(size)).alias("hx"), (centre(v) * F.lit(size * 3**0.5)).alias("hy")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs in one aggregation; 0 where there is none."""
    pair = lambda a, b: F.nanvl(F.coalesce(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), F.lit(0.0))
    one = df.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pair(a, b).alias("corr")) for a, b in product(columns, columns))).alias("m"))
    return one.select(F.explode("m").alias("r")).select("r.*")


def order_statistics(df: DataFrame, ranks: dict[str, Callable[[int], Sequence[int]]]) -> dict[str, dict[int, float]]:
    """The values at some ranks (from 0) of each column's values, null and NaN left out; exact, for any size.

    Each scan counts the values in `BINS` parts of every range still in question, and the part
    that holds the rank is the next range; a range of one value is done. The driver sees counts only.
    """
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    ends = long_stats(df, list(ranks), {"n": lambda c: F.count(value(c)), "lo": lambda c: F.min(value(c)), "hi": lambda c: F.max(value(c))}).collect()
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}
    open_: list[tuple[str, int, float, float, int]] = []  # column, rank, range, values below it
    for r in ends:
        open_ += [(r["column"], k, r["lo"], r["hi"], 0) for k in sorted(set(ranks[r["column"]](r["n"]))) if 0 <= k < r["n"]]
    while open_:
        ranges = sorted({(c, lo, hi) for c, _, lo, hi, _ in open_ if lo < hi})
        parts: dict[int, list] = {}
        if ranges:
            at = []
            for i, (c, lo, hi) in enumerate(ranges):
                v, step = value(c), hi / BINS - lo / BINS
                k = F.least(F.floor((v - F.lit(lo)) / F.lit(step)), F.lit(BINS - 1)) if step > 0 else F.when(v == F.lit(hi), F.lit(1)).otherwise(F.lit(0))
                at.append(F.struct(F.lit(i).alias("i"), F.when(v.between(lo, hi), k).cast("int").alias("k"), v.alias("v")))
            rows = df.select(F.explode(F.array(*at)).alias("x")).select("x.*").where("k is not null")
            for r in rows.groupBy("i", "k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i", "k").collect():
                parts.setdefault(r["i"], []).append(r)
        following = []
        for c, rank, lo, hi, below in open_:
            if lo == hi:
                found[c][rank] = lo
                continue
            for r in parts[ranges.index((c, lo, hi))]:
                if rank < below + r["n"]:
                    following.append((c, rank, r["lo"], r["hi"], below))
                    break
                below += r["n"]
        open_ = following
    return found


#: Parts of a range that are counted in one scan.
BINS = 2048


def bounds(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Exact interpolated quantiles with extremes and mean."""
    stats = long_stats(df, columns, {"n": lambda c: F.count(F.nanvl(F.col(c).cast("double"), F.lit(None))), "min": lambda c: F.min(F.col(c).cast("double")), "max": lambda c: F.max(F.col(c).cast("double")), "mean": lambda c: F.avg(F.col(c).cast("double"))}).collect()
    place = lambda p, n: p * (n - 1)
    found = order_statistics(df, dict.fromkeys(columns, lambda n: [k for p in (low, high) for k in (int(place(p, n)), int(place(p, n)) + 1)]))

    def at(c: str, p: float, n: int) -> float | None:
        if not n:
            return None
        k = int(place(p, n))
        a = found[c][k]
        return a + (place(p, n) - k) * (found[c].get(k + 1, a) - a)

    rows = [(r["column"], at(r["column"], low, r["n"]), at(r["column"], high, r["n"]), r["min"], r["max"], r["mean"]) for r in stats]
    return df.sparkSession.createDataFrame(rows, "column string, p_low double, p_high double, min double, max double, mean double")


def monthly_means(df: DataFrame, time: str, candidates: Sequence[str]) -> DataFrame:
    """Per calendar month mean and count of the first candidate column there is; null means without any."""
    value = next((F.col(c).cast("double") for c in candidates if c in df.columns), F.lit(None).cast("double"))
    return df.groupBy(F.date_trunc("month", time).cast("timestamp_ntz").alias("month")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def trend(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def distribution(df: DataFrame, c: str, value: str) -> DataFrame:
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
