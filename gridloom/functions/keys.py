"""Keys: calendar index, grid indices, regions, codes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regions as inclusive boxes (x from, x to, y from, y to) in metres; the first that fits counts.
REGIONS = {
    "amundsen_sea": (-1800000.0, -1100000.0, -800000.0, -100000.0),
    "antarctic_peninsula": (-2500000.0, -1000000.0, 500000.0, 2000000.0),
    "lambert_amery": (1500000.0, 2500000.0, 0.0, 1200000.0),
    "ronne": (-1500000.0, -500000.0, 0.0, 1500000.0),
    "ross": (-500000.0, 1000000.0, -1500000.0, -500000.0),
    "totten_and_aurora": (1800000.0, 2600000.0, -1500000.0, -500000.0),
}
#: Weights, codes and negatives per positive by region.
REGION_WEIGHTS = {"amundsen_sea": 2.0, "totten_and_aurora": 2.0, "antarctic_peninsula": 1.5, "lambert_amery": 1.0, "ross": 0.7, "ronne": 0.7}
REGION_CODES = {"amundsen_sea": 0, "antarctic_peninsula": 1, "lambert_amery": 2, "ronne": 3, "ross": 4, "totten_and_aurora": 5, "sample": 6}
NEGATIVES_PER_POSITIVE = {"amundsen_sea": 5, "totten_and_aurora": 5, "antarctic_peninsula": 8, "lambert_amery": 12, "ross": 12, "ronne": 12}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_idx(ts: Column | str) -> Column:
    """year * 12 + month."""
    return (F.year(col(ts)) * 12 + F.month(col(ts))).cast("int")


def with_month_idx(df, *candidates: str):
    """The frame with `month_idx`, as it is if it has one, else from the first of the time columns it has."""
    if "month_idx" in df.columns:
        return df
    for c in candidates or ("exact_time", "time"):
        if c in df.columns:
            return df.withColumn("month_idx", month_idx(c))
    raise ValueError("neither month_idx nor a time column")


def from_epoch_ns(c: Column | str) -> Column:
    """The date of nanoseconds since 1970."""
    return F.to_date(F.timestamp_seconds(col(c) / F.lit(1_000_000_000)))


def cyclic_month(index: Column | str) -> tuple[Column, Column]:
    """Sine and cosine of the month's place in the year (December at 0)."""
    angle = F.pmod(col(index), F.lit(12)).cast("double") * F.lit(2 * math.pi / 12)
    return F.sin(angle), F.cos(angle)


def round_key(c: Column | str, digits: int = 1) -> Column:
    return F.round(col(c), digits)


def grid_key(c: Column | str, step: float = 0.1) -> Column:
    """An integer that is equal where coordinates are equal to within half a step."""
    return F.round(col(c) / F.lit(step)).cast("long")


def snap(c: Column | str, step: float) -> Column:
    """The nearest multiple of a step."""
    return F.round(col(c) / F.lit(step)) * F.lit(step)


def no_nan(c: Column | str) -> Column:
    """NaN as null."""
    return F.when(F.isnan(col(c)), None).otherwise(col(c))


def whole(c: Column | str) -> Column:
    """An integer, null where there is none (NaN, out of range)."""
    return no_nan(c).try_cast("int") if hasattr(Column, "try_cast") else F.expr(f"try_cast({c} as int)")


def inside(x: Column | str, y: Column | str, box: tuple[float, float, float, float]) -> Column:
    return col(x).between(box[0], box[1]) & col(y).between(box[2], box[3])


def region_of(x: Column | str, y: Column | str, boxes: dict[str, tuple[float, float, float, float]] | None = None) -> Column:
    """The name of the first box that holds the point, else `other`."""
    out = F.lit("other")
    for name, box in reversed((boxes or REGIONS).items()):
        out = F.when(inside(x, y, box), F.lit(name)).otherwise(out)
    return out


def coded(c: Column | str, values: dict, default) -> Column:
    """The value of an equal key, else the default (as for null)."""
    table = F.create_map(*(F.lit(v) for pair in values.items() for v in pair))
    return F.coalesce(F.element_at(table, F.coalesce(col(c), F.lit(""))), F.lit(default))


def wrap_longitude(c: Column | str) -> Column:
    """Degrees in [-180, 180)."""
    return F.pmod(col(c) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def flag(condition: Column) -> Column:
    """1 or 0; null stays null."""
    return condition.cast("int")


def surely(condition: Column) -> Column:
    """Null as false."""
    return F.coalesce(condition, F.lit(False))


def in_months(ts: Column | str, year: int | None, months: tuple[int, ...]) -> Column:
    """Whether a time lies in these months, of one year or any."""
    c = F.month(col(ts)).isin(*months)
    return c if year is None else c & (F.year(col(ts)) == year)


def trimmed(df, wanted):
    """The wanted columns the frame has, each once, in that order; and those it lacks."""
    order = list(dict.fromkeys(wanted))
    return df.select(*(c for c in order if c in df.columns)), [c for c in order if c not in df.columns]
