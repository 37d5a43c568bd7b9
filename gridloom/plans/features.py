"""The feature table: named features with what they need, planned together.

A feature is a column expression and the columns it reads. Those whose inputs a table has are
made, in layers, so all windows over one series share one exchange and one sort, and group
statistics come from one aggregation per set of keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.keys import REGION_CODES, coded, cyclic_month, flag
from gridloom.operators.groupstats import residuals, with_group_stats
from gridloom.operators.windows import Series

REGION, LABEL = "regional_subset_id", "basal_loss_agreement"
SERIES = Series(["x", "y"])


@dataclass(frozen=True)
class Feature:
    name: str
    needs: tuple[str, ...]
    make: Callable[[], Column]


def _over(a: str, b: str) -> Callable[[], Column]:
    return lambda: F.col(a) / (F.col(b) + 1.0)


def _times(a: str, b: str) -> Callable[[], Column]:
    return lambda: F.col(a) * F.col(b)


def _minus(a: str, b: str) -> Callable[[], Column]:
    return lambda: F.col(a) - F.col(b)


CELL = [
    Feature("bed_below_sea_level", ("bed",), lambda: flag(F.col("bed") < 0)),
    Feature("draft_x_thermal_access", ("ice_draft", "dist_to_ocean"), _over("ice_draft", "dist_to_ocean")),
    Feature("grounding_line_vulnerability", ("thickness", "dist_to_grounding_line"), _over("thickness", "dist_to_grounding_line")),
    # a slope magnitude is never negative, so this is 0 wherever it is known; kept as defined
    Feature("retrograde_flag", ("bed_slope",), lambda: flag(F.col("bed_slope") < 0)),
    Feature("thermal_driving_x_draft", ("t_star_mo", "ice_draft"), _times("t_star_mo", "ice_draft")),
    Feature("thermal_anomaly", ("t_star_mo", "t_star_quarterly_avg"), _minus("t_star_mo", "t_star_quarterly_avg")),
    Feature("salinity_stratification_proxy", ("so_mo", "clamped_depth"), _times("so_mo", "clamped_depth")),
    Feature("lwe_trend", ("lwe_mo", "lwe_quarterly_avg"), _minus("lwe_mo", "lwe_quarterly_avg")),
    Feature("ocean_heat_content_proxy", ("thetao_mo", "ice_draft", "dist_to_ocean"), lambda: F.col("thetao_mo") * F.abs("ice_draft") / (F.col("dist_to_ocean") + 1.0)),
    Feature("draft_ratio", ("ice_draft", "thickness"), lambda: F.abs("ice_draft") / (F.col("thickness") + 1.0)),
    Feature("thermal_x_gl_proximity", ("t_star_mo", "dist_to_grounding_line"), _over("t_star_mo", "dist_to_grounding_line")),
    Feature("freezing_departure", ("thetao_mo", "t_f_mo"), _minus("thetao_mo", "t_f_mo")),
    Feature("bed_geometry_risk", ("bed_slope", "bed"), lambda: F.col("bed_slope") * F.least(F.col("bed"), F.lit(0.0))),
    Feature("mass_flux_proxy", ("delta_h", "ice_area"), _times("delta_h", "ice_area")),
    Feature("sin_month", ("month_idx",), lambda: cyclic_month("month_idx")[0]),
    Feature("cos_month", ("month_idx",), lambda: cyclic_month("month_idx")[1]),
    Feature("region_cat_idx", (REGION,), lambda: coded(REGION, REGION_CODES, 6)),
]


def _series() -> list[Feature]:
    s, out = SERIES, []
    out += [
        Feature("pixel_mean_delta_h", ("delta_h",), lambda: s.mean_rows("delta_h", None)),
        Feature("delta_h_deviation", ("delta_h",), lambda: F.col("delta_h") - s.mean_rows("delta_h", None)),
        Feature("surface_slope_change", ("surface_slope",), lambda: s.step("surface_slope")),
        Feature("t_star_mom_change", ("t_star_mo",), lambda: s.momentum("t_star_mo")),
        Feature("delta_h_mom_change", ("delta_h",), lambda: s.momentum("delta_h")),
        Feature("delta_h_momentum", ("delta_h",), lambda: s.momentum("delta_h")),
        Feature("delta_h_acceleration", ("delta_h",), lambda: s.acceleration("delta_h")),
        Feature("delta_h_deseason", ("delta_h",), lambda: s.deseasoned("delta_h")),
        Feature("t_star_momentum", ("t_star_mo",), lambda: s.momentum("t_star_mo")),
        Feature("t_star_sustained_anomaly", ("t_star_mo",), lambda: s.sustained("t_star_mo")),
        Feature("lwe_momentum", ("lwe_mo",), lambda: s.momentum("lwe_mo")),
        Feature("lwe_sustained_trend", ("lwe_mo",), lambda: s.sustained("lwe_mo")),
    ]
    for c, name in (("t_star_mo", "t_star"), ("lwe_mo", "lwe"), ("delta_h", "delta_h")):
        out.append(Feature(f"{name}_6mo_avg", (c,), lambda c=c: s.mean_rows(c, 6)))
        out.append(Feature(f"{name}_rate", (c,), lambda c=c: s.rate(c)))
    return out


def made(df: DataFrame, features: list[Feature]) -> DataFrame:
    """The frame with the features whose inputs it has."""
    have = set(df.columns)
    return df.withColumns({f.name: f.make() for f in features if set(f.needs) <= have})


def with_context(df: DataFrame) -> DataFrame:
    """Means of mascon and region months, and the change's z-score in its region and month."""
    df = with_group_stats(df, ["mascon_id", "month_idx"], {"mascon_mean_delta_h": F.avg("delta_h"), "mascon_mean_t_star": F.avg("t_star_mo")})
    df = with_group_stats(df, [REGION, "month_idx"], {"regional_t_star_climatology": F.avg("t_star_mo"), "regional_lwe_mean": F.avg("lwe_mo"), "_m": F.avg("delta_h"), "_s": F.stddev_samp("delta_h")})
    new = {"regional_t_star_anomaly": F.col("t_star_mo") - F.col("regional_t_star_climatology"), "regional_delta_h_percentile": (F.col("delta_h") - F.col("_m")) / (F.col("_s") + F.lit(1e-8))}
    return df.withColumns(new).drop("_m", "_s")


def labelled(df: DataFrame, mode: str = "dual_sensor", by_region: bool = True, fit: Column | None = None) -> DataFrame:
    """1 where mass is well below its mascon's mean and, in dual mode, height change well below its region's in that month.

    by_region: mascon statistics of the region's rows only, as when regions are worked on one by
    one. fit: statistics of these rows only (all rows by default). The fused mass column is dropped.
    """
    low = lambda c, m, s: F.coalesce(F.col(c) < F.col(m) - 0.5 * F.col(s), F.lit(False))
    keys = [REGION, "mascon_id"] if by_region else ["mascon_id"]
    df = with_group_stats(df, keys, {"_lm": F.avg("lwe_quarterly_avg"), "_ls": F.stddev_samp("lwe_quarterly_avg")}, fit)
    hit = low("lwe_quarterly_avg", "_lm", "_ls")
    if mode == "dual_sensor":
        df = with_group_stats(df, [REGION, "month_idx"], {"_hm": F.avg("delta_h"), "_hs": F.stddev_samp("delta_h")}, fit)
        hit = hit & low("delta_h", "_hm", "_hs")
    elif mode != "grace_anomaly":
        raise ValueError(f"no label mode {mode!r}")
    return df.withColumn(LABEL, hit.cast("int")).drop("_lm", "_ls", "_hm", "_hs", "lwe_fused")


def labelled_by_percentile(df: DataFrame) -> DataFrame:
    """The earlier label: fused mass in its mascon month's lowest quarter and change below the cell's mean minus its deviation."""
    df = with_group_stats(df, ["mascon_id", "month_idx"], {"_p": F.percentile("lwe_fused", F.lit(0.25))})
    df = with_group_stats(df, ["x", "y"], {"_m": F.avg("delta_h"), "_s": F.stddev_samp("delta_h")}, many=True)
    hit = F.coalesce(F.col("lwe_fused") < F.col("_p"), F.lit(False)) & F.coalesce(F.col("delta_h") < F.col("_m") - F.col("_s"), F.lit(False))
    return df.withColumn(LABEL, hit.cast("int")).drop("_p", "_m", "_s")


#: Columns the label is made of; leave them out of a model to rule out leakage.
LABEL_INPUTS = ("lwe_quarterly_avg", "lwe_quarterly_std", "delta_h")


def ml_ready(store: DataFrame, mode: str = "dual_sensor") -> DataFrame:
    """The feature store with region, label and all features: 41 further columns beside the label."""
    df = labelled(store.where(F.col(REGION).isNotNull()), mode)
    return made(with_context(made(df, CELL)), _series())


#: Numeric features in their order.
NUMERIC = [
    "surface", "bed", "thickness", "bed_slope", "dist_to_grounding_line", "clamped_depth", "dist_to_ocean", "ice_draft", "delta_h", "ice_area", "surface_slope", "h_surface_dynamic",
    "bed_below_sea_level", "draft_x_thermal_access", "grounding_line_vulnerability", "retrograde_flag", "pixel_mean_delta_h", "delta_h_deviation", "surface_slope_change",
    "thermal_driving_x_draft", "thermal_anomaly", "salinity_stratification_proxy", "lwe_trend", "sin_month", "cos_month",
    "mascon_mean_delta_h", "mascon_mean_t_star", "regional_delta_h_percentile", "regional_lwe_mean", "lwe_mo", "lwe_quarterly_avg", "lwe_quarterly_std",
    "thetao_mo", "t_star_mo", "so_mo", "t_f_mo", "t_star_quarterly_avg", "t_star_quarterly_std", "thetao_quarterly_avg", "thetao_quarterly_std",
    "regional_t_star_climatology", "regional_t_star_anomaly", "t_star_6mo_avg", "lwe_6mo_avg", "delta_h_6mo_avg", "t_star_rate", "lwe_rate", "delta_h_rate", "t_star_mom_change", "delta_h_mom_change",
    "ocean_heat_content_proxy", "draft_ratio", "thermal_x_gl_proximity", "freezing_departure", "bed_geometry_risk", "mass_flux_proxy",
    "delta_h_momentum", "delta_h_acceleration", "delta_h_deseason", "t_star_momentum", "t_star_sustained_anomaly", "lwe_momentum", "lwe_sustained_trend", "region_cat_idx",
]
#: Columns of the second model: those taken relative to their region's mean, those that stay as they are, and those with lags.
RELATIVE = ["thetao_mo", "t_star_mo", "so_mo", "t_f_mo", "thetao_quarterly_avg", "thetao_quarterly_std", "t_star_quarterly_avg", "t_star_quarterly_std", "regional_t_star_climatology"]
STATIC = ["dist_to_grounding_line", "grounding_line_vulnerability", "retrograde_flag", "bed_slope", "bed", "clamped_depth", "ice_draft", "thickness", "ice_area", "lwe_trend"]
LAGGED, LAGS = ["thetao_mo", "t_star_mo"], (1, 3)
ENGINEERED = [
    Feature("thermal_driving", ("thetao_mo", "t_f_mo"), _minus("thetao_mo", "t_f_mo")),
    Feature("t_star_anomaly", ("t_star_mo", "regional_t_star_climatology"), _minus("t_star_mo", "regional_t_star_climatology")),
]
#: The region weights that multiply the first ones in the second model.
SECOND_WEIGHTS = {"amundsen_sea": 10.0, "totten_and_aurora": 5.0, "bellingshausen": 5.0, "antarctic_peninsula": 2.0, "ross": 2.0, "ronne": 2.0}


def numeric_features(df: DataFrame, exclude_label_inputs: bool = False) -> list[str]:
    """Feature columns of a table in their fixed order."""
    have = set(df.columns) - (set(LABEL_INPUTS) if exclude_label_inputs else set())
    return [c for c in NUMERIC if c in have]


def firewalled(df: DataFrame, *leaks: str) -> DataFrame:
    """The table, after making sure that columns which would give the label away are not in it."""
    if there := [c for c in leaks or ("lwe_fused",) if c in df.columns]:
        raise ValueError(f"columns that give the label away: {there}")
    return df


def second_set(df: DataFrame, fit: Column) -> tuple[DataFrame, list[str]]:
    """The second model's columns, made from a table of all features: 9 residuals from the region's mean over the rows to
    learn from, 4 lags, 4 engineered ones and 10 as they are; and their names, 27 where all inputs are there."""
    relative, lagged = ([c for c in cs if c in df.columns] for cs in (RELATIVE, LAGGED))
    df = residuals(df, [REGION], relative, fit)
    lags = {f"{c}_lag{n}": SERIES.before(c, n) for c in lagged for n in LAGS}
    angle = F.lit(2.0 * 3.14159265) * F.col("month_idx") / F.lit(12.0)
    made = {f.name: f.make() for f in ENGINEERED if set(f.needs) <= set(df.columns)} | {"sin_month": F.sin(angle), "cos_month": F.cos(angle)}
    df = df.withColumns(lags | made)
    names = [*(f"{c}_resid" for c in relative), *lags, *made, *(c for c in STATIC if c in df.columns)]
    return df, names
