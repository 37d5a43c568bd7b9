"""Data-quality checks: each gives rows (check, passed, n_bad, n)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.profile import bounds, completeness
from gridloom.sources.tables import union_by_name

#: Plausible ranges of the variables, and of coordinates and time.
RANGES = {
    "surface": (-500, 5000), "bed": (-3000, 5000), "thickness": (0, 5000), "bed_slope": (0, 10), "dist_to_grounding_line": (0, 2e6),
    "clamped_depth": (0, 6000), "dist_to_ocean": (0, 1.5e6), "ice_draft": (-3000, 500), "delta_h": (-200, 200), "ice_area": (0, 1e12),
    "surface_slope": (0, 10), "h_surface_dynamic": (-500, 5000), "thetao": (-3.5, 6), "so": (25, 38), "T_f": (-5, 1), "T_star": (-3, 10), "lwe_length": (-500, 500),
}
COORDINATES = (-3_500_000.0, 3_500_000.0)
TIMES = ("2018-01-01", "2026-07-01")
#: Type families by Spark's type names.
FAMILIES = {"float": {"float", "double"}, "int": {"tinyint", "smallint", "int", "bigint"}, "ts": {"timestamp", "timestamp_ntz", "date"}, "string": {"string"}}


def counted(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Each condition names bad rows; all are counted in one scan."""
    n = F.count(F.lit(1))
    one = df.agg(F.array(*(F.struct(F.lit(k).alias("check"), F.count_if(F.coalesce(bad, F.lit(False))).alias("n_bad"), n.alias("n")) for k, bad in checks.items())).alias("a"))
    return one.select(F.explode("a").alias("r")).select("r.check", (F.col("r.n_bad") == 0).alias("passed"), "r.n_bad", "r.n")


def schema_check(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """Missing columns and columns of another type family; further columns are fine."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [(c, have.get(c), c in have and (kind == "any" or have[c] in FAMILIES[kind])) for c, kind in required.items()]
    return df.sparkSession.createDataFrame(rows, "column string, type string, passed boolean")


def null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counted(df, {f"null_{k}": F.col(k).isNull() for k in keys})


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


def range_checks(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    ranges = {c: r for c, r in (ranges or RANGES).items() if c in df.columns}
    return counted(df, {f"range_{c}": (F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in ranges.items()})


def coordinate_checks(df: DataFrame) -> DataFrame:
    return counted(df, {f"bounds_{c}": ~F.col(c).between(*COORDINATES) for c in ("y", "x")})


def time_check(df: DataFrame, time: str, span: tuple[str, str] = TIMES) -> DataFrame:
    """Outside the span, its end not included; compared as times."""
    c = F.col(time).cast("timestamp_ntz")
    return counted(df, {f"span_{time}": (c < F.lit(span[0]).cast("timestamp_ntz")) | (c >= F.lit(span[1]).cast("timestamp_ntz"))})


def orphans(df: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys that the parent does not have."""
    return df.select(*keys).subtract(parent.select(*keys))


def orphan_count(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return df.join(parent.select(key).distinct(), key, "left_anti").agg(F.count_distinct(key).alias("n_orphans"))


def shared(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def spans(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """First and last time of each table."""
    return union_by_name(df.agg(F.lit(name).alias("table"), F.min(c).alias("first"), F.max(c).alias("last")) for name, (df, c) in tables.items())


def contained(inner: DataFrame, outer: DataFrame, c: str) -> DataFrame:
    """Whether the inner table's span lies within the outer's."""
    ends = lambda df, tag: df.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(tag))
    both = union_by_name([ends(inner, "i"), ends(outer, "o")], missing=True).agg(F.max("i").alias("i"), F.max("o").alias("o"))
    return both.select((F.col("i.lo") >= F.col("o.lo")).alias("starts_within"), (F.col("i.hi") <= F.col("o.hi")).alias("ends_within"))


def fused_checks(fused: DataFrame, anchors: Sequence[str] = ("y", "x", "exact_time", "month_idx", "delta_h")) -> DataFrame:
    """Anchors are there, deviations never null beside their mean, allocation keeps signs and needs its inputs."""
    c = F.col
    checks = {f"anchor_{a}": c(a).isNull() for a in anchors}
    for name in ("t_star", "thetao", "lwe"):
        checks[f"std_{name}"] = c(f"{name}_quarterly_avg").isNotNull() & c(f"{name}_quarterly_std").isNull()
        checks[f"std_sign_{name}"] = c(f"{name}_quarterly_std") < 0
    checks["sign_flip"] = (F.signum("lwe_fused") != F.signum("lwe_mo")) & (c("lwe_fused") != 0)
    checks["allocated_without_mascon"] = c("mascon_id").isNull() & c("lwe_fused").isNotNull()
    checks["bed_above_surface"] = c("bed") > c("surface")
    return counted(fused, checks)


def conservation(fused: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Per mascon and month the allocated sum against value times count; then the drift over all."""
    groups = drifts(fused)
    return groups.agg(F.count(F.lit(1)).alias("n_groups"), F.max("drift").alias("max_drift"), F.avg("drift").alias("mean_drift"), F.count_if(F.col("drift") > tolerance).alias("n_violations"))


def drifts(fused: DataFrame) -> DataFrame:
    rows = fused.where("lwe_fused is not null")
    return rows.groupBy("mascon_id", "month_idx").agg(F.abs(F.sum("lwe_fused") - F.max("lwe_mo") * F.count(F.lit(1))).alias("drift"), F.count(F.lit(1)).alias("n"))


def tile_audit(df: DataFrame, column: str, warn: float, low: float, high: float) -> DataFrame:
    """Values beyond a warning magnitude and outside hard limits."""
    return counted(df, {"warn_magnitude": F.abs(column) > warn, "outside_limits": (F.col(column) < low) | (F.col(column) > high)})


#: Columns of the fused store; those whose lack ends the checks.
STORE = [
    "y", "x", "exact_time", "month_idx", "mascon_id", "surface", "bed", "thickness", "bed_slope", "dist_to_grounding_line", "clamped_depth", "dist_to_ocean", "ice_draft",
    "delta_h", "ice_area", "surface_slope", "h_surface_dynamic", "thetao_mo", "t_star_mo", "so_mo", "t_f_mo",
    "t_star_quarterly_avg", "t_star_quarterly_std", "thetao_quarterly_avg", "thetao_quarterly_std", "lwe_mo", "lwe_quarterly_avg", "lwe_quarterly_std", "lwe_fused",
]
CRITICAL = ("lwe_fused", "lwe_mo", "delta_h", "mascon_id")


def store_columns(df: DataFrame) -> DataFrame:
    """Which columns of the store are there, and which are critical."""
    rows = [(c, c in df.columns, c in CRITICAL) for c in STORE]
    return df.sparkSession.createDataFrame(rows, "column string, present boolean, critical boolean")


def sparsity(df: DataFrame, columns: Sequence[str] = STORE) -> DataFrame:
    """Per column of the store that is there how many rows have it; one scan."""
    return completeness(df, [c for c in columns if c in df.columns])


def amplification(df: DataFrame) -> DataFrame:
    """The allocated mass beside the value it comes from: extremes, mean, 1st and 99th percentile, and the largest magnitude as a multiple."""
    rows = df.where(F.col("lwe_fused").isNotNull())
    p = bounds(rows, ["lwe_fused"]).select("p_low", "p_high")
    ends = rows.agg(*(f(c).alias(f"{n}_{c}") for c in ("lwe_fused", "lwe_mo") for n, f in (("min", F.min), ("max", F.max))), F.avg("lwe_fused").alias("mean_lwe_fused"))
    largest = lambda c: F.greatest(F.abs(f"min_{c}"), F.abs(f"max_{c}"))
    both = ends.select(F.lit(1).alias("one"), "*").join(p.select(F.lit(1).alias("one"), "*"), "one").drop("one")
    return both.withColumn("amplification", largest("lwe_fused") / F.greatest(F.coalesce(largest("lwe_mo"), F.lit(1.0)), F.lit(1e-12)))


def share_checks(df: DataFrame, mask: str | None = None, allowed: Sequence[int] = (1, 3), freezing: str | None = None, driving: str | None = None, most: float = 5.0) -> DataFrame:
    """Mask values that are not allowed fail; freezing points above 0 fail from `most` percent on; the share of positive driving is only told (null)."""
    n = lambda c: F.count(c)
    share = lambda c: 100.0 * F.count_if(F.col(c) > 0) / F.nullif(n(c), F.lit(0))
    parts = []
    if mask:
        odd = F.count_if(~F.col(mask).isin(*allowed))
        parts.append(F.struct(F.lit("mask_values").alias("check"), (odd == 0).alias("passed"), odd.cast("double").alias("value")))
    if freezing:
        parts.append(F.struct(F.lit("freezing_above_0").alias("check"), (share(freezing) < most).alias("passed"), share(freezing).alias("value")))
    if driving:
        parts.append(F.struct(F.lit("driving_above_0").alias("check"), F.lit(None).cast("boolean").alias("passed"), share(driving).alias("value")))
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def raster_sanity(df: DataFrame, slope: str, distance: str, steepest: float = 5.0, farthest: float = 1000.0) -> DataFrame:
    """Warnings: a slope steeper than it can be, and grounding lines that are nowhere far away; skipped without the column."""
    rules = [("steep_slope", slope, F.max(slope) <= steepest, F.max(slope)), ("near_grounding_line", distance, F.max(distance) >= farthest, F.max(distance))]
    have = [(name, ok, value) for name, c, ok, value in rules if c in df.columns]
    tracked_rows = df.agg(F.array(*(F.struct(F.lit(n).alias("check"), F.when(ok, "pass").otherwise("warn").alias("state"), v.cast("double").alias("value")) for n, ok, v in have)).alias("a"))
    out = tracked_rows.select(F.explode("a").alias("r")).select("r.*")
    missing = [(name, "skip", None) for name, c, _, _ in rules if c not in df.columns]
    return out.unionByName(df.sparkSession.createDataFrame(missing, "check string, state string, value double")) if missing else out


def tracked(checks: dict[str, DataFrame | None], warnings: Sequence[str] = ()) -> DataFrame:
    """All checks (rows check, passed) of several tables as (table, check, state): pass, fail, warn where a failure is only a warning, skip without a table."""
    parts, skipped = [], [(name, "*", "skip") for name, df in checks.items() if df is None]
    for name, df in checks.items():
        if df is not None:
            failed = F.when(F.col("check").isin(*warnings), "warn").otherwise("fail")
            parts.append(df.select(F.lit(name).alias("table"), "check", F.when(F.col("passed"), "pass").otherwise(failed).alias("state")))
            spark = df.sparkSession
    if skipped and parts:
        parts.append(spark.createDataFrame(skipped, "table string, check string, state string"))
    return union_by_name(parts)


def tracked_code(states: DataFrame) -> int:
    """0: all passed or skipped, 1: warnings, 2: failures."""
    found = {r["state"] for r in states.select("state").distinct().collect()}
    return 2 if "fail" in found else int("warn" in found)


def exit_code(checks: DataFrame, warnings: Sequence[str] = ()) -> int:
    """0: all passed, 1: only warnings failed, 2: others did. The table has a row a check."""
    failed = [r["check"] for r in checks.where(~F.col("passed")).select("check").collect()]
    return 2 if any(f not in warnings for f in failed) else int(bool(failed))
