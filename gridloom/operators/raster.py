"""Raster operators on cells (iy, ix) or coordinates, as relational plans.

A cell is a row with integer indices; neighbours meet by windows or equi joins on indices.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.physics import EARTH_RADIUS
from gridloom.sources.tables import checkpointed


def grid(spark: SparkSession, n: int, step: float, m: int | None = None) -> DataFrame:
    """Cell centres of an n x m grid around the origin, y descending, with the row-major cell number."""
    m = m or n
    cells = spark.range(n * m).select(F.floor(F.col("id") / m).cast("int").alias("iy"), (F.col("id") % m).cast("int").alias("ix"), F.col("id").alias("cell"))
    return cells.withColumns({"x": (F.col("ix") + 0.5 - m / 2) * F.lit(float(step)), "y": (F.lit(n / 2) - F.col("iy") - 0.5) * F.lit(float(step))})


def cell_id(iy: str, ix: str, nx: int) -> Column:
    return F.col(iy).cast("long") * nx + F.col(ix)


def slope(df: DataFrame, c: str, step: float, out: str = "slope", by: Sequence[str] = ()) -> DataFrame:
    """Gradient magnitude by central differences; a border cell stands in for its missing neighbour; a missing value gives null.

    Neighbours are the adjacent indices, not the next rows: a gap in the grid has no value.
    """
    def one(axis: str, along: str) -> Column:
        w = Window.partitionBy(*by, along).orderBy(axis)
        edge_low, edge_high = F.min(axis).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.max(axis).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        at = lambda f, d, edge: F.when(F.col(axis) == edge, F.col(c)).when(f(axis, 1).over(w) == F.col(axis) + d, f(c, 1).over(w))
        return (at(F.lead, 1, edge_high) - at(F.lag, -1, edge_low)) / F.lit(2.0 * step)

    df = df.withColumn("_gx", one("ix", "iy")).withColumn("_gy", one("iy", "ix"))
    size = F.sqrt(F.pow("_gx", 2) + F.pow("_gy", 2))
    return df.withColumn(out, F.when(F.col(c).isNotNull(), size)).drop("_gx", "_gy")


def _envelope(g: np.ndarray) -> np.ndarray:
    """Squared distances along a row from the squared distances along columns: the lower envelope of parabolas."""
    n = len(g)
    finite = np.flatnonzero(np.isfinite(g))
    if not len(finite):
        return np.full(n, np.inf)
    v, z = [int(finite[0])], [-np.inf]
    for q in map(int, finite[1:]):
        while True:
            p = v[-1]
            s = ((g[q] + q * q) - (g[p] + p * p)) / (2 * q - 2 * p)
            if s > z[-1]:
                break
            v.pop()
            z.pop()
        v.append(q)
        z.append(s)
    at = np.searchsorted(np.array(z), np.arange(n), "right") - 1
    v = np.array(v)[at]
    return (np.arange(n) - v) ** 2 + g[v]


def distance_to(df: DataFrame, target: Column, step: float, out: str = "distance") -> DataFrame:
    """Euclidean distance of every cell to the nearest target cell, null without any: columns by windows, rows by an envelope.

    A group of the second pass is one grid row, whose length the grid's width bounds.
    """
    w = Window.partitionBy("ix").orderBy("iy")
    here = F.when(target, F.col("iy"))
    up = F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = F.least(F.col("iy") - up, down - F.col("iy"))
    rows = df.select("iy", "ix", near.alias("near"))

    def along(table: pa.Table) -> pa.Table:
        ix = table.column("ix").to_numpy()
        near = table.column("near").to_numpy(zero_copy_only=False).astype(float)
        low = int(ix.min())
        g = np.full(int(ix.max()) - low + 1, np.inf)
        g[ix - low] = np.where(np.isnan(near), np.inf, near**2)
        d = np.sqrt(_envelope(g))[ix - low] * step
        return pa.table({"iy": table.column("iy"), "ix": table.column("ix"), out: pa.array(np.where(np.isfinite(d), d, np.nan), from_pandas=True)})

    return df.join(rows.groupBy("iy").applyInArrow(along, f"iy int, ix int, {out} double"), ["iy", "ix"])


def mosaic(tiles: DataFrame, keys: Sequence[str], values: Sequence[str], sigma: str, tile: str) -> DataFrame:
    """Per cell the values of the tile of least sigma, ties to the earlier tile; without sigma a value does not count."""
    best = F.min_by(F.struct(*values, F.col(sigma), F.col(tile)), F.struct(sigma, tile))
    return tiles.where(F.col(sigma).isNotNull()).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def bilinear(df: DataFrame, c: str, factor: int = 2) -> DataFrame:
    """Values between cell centres on a grid finer by a factor; null outside or beside a missing cell.

    Fine cells at row i lie at (i + 0.5) / factor - 0.5 coarse rows.
    """
    shares = [((k + 0.5) / factor) - 0.5 for k in range(factor)]
    parts = []
    for a, v in enumerate(shares):
        for b, u in enumerate(shares):
            for dy in (0, 1):
                for dx in (0, 1):
                    fy, fx = v - np.floor(v), u - np.floor(u)
                    weight = (fy if dy else 1 - fy) * (fx if dx else 1 - fx)
                    parts.append((a, b, int(np.floor(v)) + dy, int(np.floor(u)) + dx, float(weight)))
    # a coarse cell sends its share to every fine cell it is a corner of
    send = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(oy).alias("oy"), F.lit(ox).alias("ox"), F.lit(w).alias("w")) for a, b, oy, ox, w in parts)))
    rows = df.select("iy", "ix", F.col(c).alias("v"), send.alias("s"))
    rows = rows.select(((F.col("iy") - F.col("s.oy")) * factor + F.col("s.a")).alias("iy"), ((F.col("ix") - F.col("s.ox")) * factor + F.col("s.b")).alias("ix"), (F.col("v") * F.col("s.w")).alias("part"))
    sums = rows.groupBy("iy", "ix").agg(F.sum("part").alias(c), F.count("part").alias("k"))
    return sums.where("k = 4").drop("k")


def nearest_cells(df: DataFrame, factor: int = 2) -> DataFrame:
    """Every cell repeated factor x factor times on the finer grid."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(factor * factor - 1)))
    rows = df.withColumn("_k", spread)
    return rows.withColumns({"iy": F.col("iy") * factor + F.floor(F.col("_k") / factor).cast("int"), "ix": F.col("ix") * factor + F.col("_k") % factor}).drop("_k")


def reindexed(points: DataFrame, cells: DataFrame, step: float, tolerance: float) -> DataFrame:
    """Each point with the cell of the nearest centre on each axis, if it is within the tolerance on both."""
    at = lambda df: df.withColumns({"_kx": F.round(F.col("x") / step - 0.5).cast("long"), "_ky": F.round(F.col("y") / step - 0.5).cast("long")})
    c = at(cells).select("_kx", "_ky", F.col("x").alias("cx"), F.col("y").alias("cy"), *[x for x in cells.columns if x not in ("x", "y")])
    near = (F.abs(F.col("x") - F.col("cx")) <= tolerance) & (F.abs(F.col("y") - F.col("cy")) <= tolerance)
    keep = [x for x in c.columns if x not in ("_kx", "_ky")]
    return at(points).join(c, ["_kx", "_ky"], "left").select(*points.columns, *(F.when(near, F.col(k)).alias(k) for k in keep))


def axis(df: DataFrame, c: str, step: float) -> DataFrame:
    """The distinct snapped coordinates of an axis in order, with the gap to the one before; a regular axis has gaps of one step only.

    One row a coordinate, so the order is of an axis, not of the cells.
    """
    snapped_ = df.select((F.round(F.col(c) / step) * F.lit(float(step)) + F.lit(0.0)).alias(c)).distinct()
    return snapped_.withColumn("gap", F.col(c) - F.lag(c).over(Window.orderBy(c)))


def canvas(tiles: DataFrame, step: float) -> DataFrame:
    """The snapped extent over all tiles."""
    s = lambda c: F.round(F.col(c) / step) * F.lit(float(step))
    return tiles.agg(F.min(s("x")).alias("x_min"), F.max(s("x")).alias("x_max"), F.min(s("y")).alias("y_min"), F.max(s("y")).alias("y_max"))


def deepest_level(levels: DataFrame, keys: Sequence[str], value: str, level: str = "level") -> DataFrame:
    """Index of the deepest level that has a value, across gaps; -1 without any."""
    return levels.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(value).isNotNull(), F.col(level))), F.lit(-1)).alias("deepest"))


def at_depth(profiles: DataFrame, target: str = "target", points: str = "profile") -> DataFrame:
    """Linear interpolation in `points` (array of (depth, value), depth ascending) at a depth, clamped to both ends."""
    p, t = F.col(points), F.col(target)
    last = F.size(p) - 1
    below = F.size(F.filter(p, lambda z: z["depth"] <= t)) - 1
    k = F.greatest(F.lit(0), F.least(below, last - 1))
    lo, hi = F.element_at(p, k + 1), F.element_at(p, F.least(k + 2, last + 1))
    gap = hi["depth"] - lo["depth"]
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(gap > 0, (t - lo["depth"]) / gap).otherwise(F.lit(0.0))))
    return profiles.withColumn("value", lo["value"] + share * (hi["value"] - lo["value"]))


def nearest_point(queries: DataFrame, points: DataFrame, id_q: str, id_p: str, a_cube: float = 4.0) -> DataFrame:
    """The nearest point (lat, lon in degrees) of each query by great circle, with the distance in metres; ties to the smaller id.

    Both sides are cut into cubes of the unit sphere's space, at first so small that one would hold
    `a_cube` points if they lay evenly; a query meets the 27 cubes around it and is settled if its
    best point is nearer than a cube's edge; the others go on with cubes twice as large, so dense
    places are done with in small cubes. Rounds are tables in the shared folder.
    """
    def placed(df: DataFrame) -> DataFrame:
        la, lo = F.radians("lat"), F.radians("lon")
        return df.withColumns({"_x": F.cos(la) * F.cos(lo), "_y": F.cos(la) * F.sin(lo), "_z": F.sin(la)})

    q = placed(queries.select(F.col(id_q).alias("_q"), "lat", "lon"))
    p = placed(points.select(F.col(id_p).alias("_p"), "lat", "lon")).select("_p", *(F.col(c).alias(c + "p") for c in ("_x", "_y", "_z")))
    around = F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip(o, "abc", strict=True))) for o in np.ndindex(3, 3, 3)))
    q, p = checkpointed(q), checkpointed(p)
    ring, settled = min(2.0, (4 * np.pi * a_cube / max(1, p.count())) ** 0.5), []
    while True:
        cut = lambda c: F.floor(F.col(c) / F.lit(ring)).cast("int")  # noqa: B023, E731
        left = q.withColumn("o", F.explode(around)).withColumns({k: cut(f"_{k}") + F.col(f"o.{n}") - 1 for k, n in zip("xyz", "abc", strict=True)})
        right = p.withColumns({k: cut(f"_{k}p") for k in "xyz"})
        chord = F.sqrt(sum(F.pow(F.col(f"_{k}") - F.col(f"_{k}p"), 2) for k in "xyz"))
        best = left.join(right, ["x", "y", "z"]).groupBy("_q").agg(F.min(F.struct(chord.alias("chord"), F.col("_p").alias("p"))).alias("b"))
        best = checkpointed(best)
        done = best.where(F.col("b.chord") <= ring) if ring < 2 else best
        settled.append(done)
        if ring >= 2:
            break
        q = checkpointed(q.join(done.select("_q"), "_q", "left_anti"))
        if q.limit(1).count() == 0:
            break
        ring *= 2
    out = reduce(DataFrame.unionByName, settled)
    metres = 2 * EARTH_RADIUS * F.asin(F.least(F.col("b.chord") / 2, F.lit(1.0)))
    return out.select(F.col("_q").alias(id_q), F.col("b.p").alias(id_p), metres.alias("distance"))


def valid_cells(df: DataFrame, columns: Sequence[str], mask: Column) -> DataFrame:
    """How many masked cells have each value."""
    return df.agg(*(F.count_if(mask & F.col(c).isNotNull()).alias(c) for c in columns), F.count_if(mask).alias("n_mask"))


def flattened(tiles: DataFrame, values: str = "values", fill: float | None = None) -> DataFrame:
    """Rows (iy, ix, value) from tiles (y0, x0, width, values): missing cells and NaN are left out."""
    rows = tiles.select("y0", "x0", "width", F.posexplode(values).alias("k", "value"))
    rows = rows.select((F.col("y0") + F.floor(F.col("k") / F.col("width"))).cast("int").alias("iy"), (F.col("x0") + F.col("k") % F.col("width")).cast("int").alias("ix"), "value")
    keep = F.col("value").isNotNull() & ~F.isnan("value")
    return rows.where(keep if fill is None else keep & (F.col("value") != fill))


def with_draft(df: DataFrame, surface: str = "surface", thickness: str = "thickness", wet: str | None = None) -> DataFrame:
    """Thickness without negative or missing values, the ice base's height and, with the deepest wet level, the depth to read there."""
    t = F.when(F.col(thickness) >= 0, F.col(thickness)).otherwise(F.lit(0.0))
    df = df.withColumn(thickness, t).withColumn("ice_draft", F.col(surface) - F.col(thickness))
    return df if wet is None else df.withColumn("clamped_depth", F.least(F.abs("ice_draft"), F.col(wet)))


def merged_domains(land: DataFrame, ocean: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Land values where there are any, else the ocean's; every cell of either."""
    a, b = land.select(*keys, F.col(value).alias("_land")), ocean.select(*keys, F.col(value).alias("_ocean"))
    return a.join(b, list(keys), "full").select(*keys, F.coalesce("_land", "_ocean").alias(value))


def masked(df: DataFrame, mask: str = "mask", values: Sequence[int] = (1, 3)) -> DataFrame:
    """Cells of these kinds of ground: grounded and floating ice, or floating ice and sea for (2, 3)."""
    return df.where(F.col(mask).isin(*values))


def from_shared_source(cells: DataFrame, source: str, read) -> DataFrame:
    """What `read` makes of each distinct source once, given to every cell that has it."""
    return cells.join(read(cells.select(source).distinct()), source, "left")


def regridded(cells: DataFrame, value: str, step: float, to: DataFrame) -> DataFrame:
    """Bilinear values of a lattice (ix, iy at centres (i + 1/2) step) at any points (x, y): the four cells around each, those there
    are weighing by nearness; null where none is."""
    near = to.withColumns({"_fx": F.col("x") / step - 0.5, "_fy": F.col("y") / step - 0.5}).withColumns({"_ix": F.floor("_fx"), "_iy": F.floor("_fy")})
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    near = near.withColumn("_c", corner).withColumns({"ix": (F.col("_ix") + F.col("_c.a")).cast("int"), "iy": (F.col("_iy") + F.col("_c.b")).cast("int")})
    part = lambda f, i, k: F.when(F.col(k) == 1, F.col(f) - F.col(i)).otherwise(1 - (F.col(f) - F.col(i)))
    near = near.withColumn("_w", part("_fx", "_ix", "_c.a") * part("_fy", "_iy", "_c.b"))
    rows = near.join(cells.select("ix", "iy", F.col(value).alias("_v")), ["ix", "iy"], "left")
    w = F.when(F.col("_v").isNotNull(), F.col("_w"))
    return rows.groupBy(*to.columns).agg((F.sum(w * F.col("_v")) / F.nullif(F.sum(w), F.lit(0.0))).alias(value))


def cropped(df: DataFrame, lat: str = "lat", north: float = -50.0) -> DataFrame:
    return df.where(F.col(lat) <= north)


def raised_by(static: DataFrame, dynamic: DataFrame, keys: Sequence[str], base: str, change: str, out: str) -> DataFrame:
    """A static value plus a change in time, for every observation of the change."""
    return dynamic.join(static.select(*keys, base), list(keys), "left").withColumn(out, F.col(base) + F.col(change))
