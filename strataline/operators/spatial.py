"""Lattices: boxes, derivatives, distances and pair statistics of cells."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import planar_km


def in_boxes(cells: DataFrame, boxes: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Cells with the box (lon0, lon1, lat0, lat1, inclusive) they lie in; boxes overlap and are a handful."""
    inside = F.col(lon).between(F.col("lon0"), F.col("lon1")) & F.col(lat).between(F.col("lat0"), F.col("lat1"))
    return cells.join(boxes, inside)


def _slope(value: str, keys: list[str], along: str, step: float):
    """Central differences, one-sided at the ends; null where a neighbour is missing. Rows must be a full lattice."""
    w = Window.partitionBy(*keys).orderBy(along)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    first, last = F.lag(along).over(w).isNull(), F.lead(along).over(w).isNull()
    x = F.col(value)
    return F.when(first, after - x).when(last, x - before).otherwise((after - before) / 2) / step


def vorticity_divergence(df: DataFrame, keys: list[str], row: str, col: str, u: str, v: str, dx: float, dy: float) -> DataFrame:
    dvdx, dudy = _slope(v, [*keys, row], col, dx), _slope(u, [*keys, col], row, dy)
    dudx, dvdy = _slope(u, [*keys, row], col, dx), _slope(v, [*keys, col], row, dy)
    return df.select("*", dvdx.alias("_vx"), dudy.alias("_uy"), dudx.alias("_ux"), dvdy.alias("_vy")).select(*df.columns, (F.col("_vx") - F.col("_uy")).alias("vort"), (F.col("_ux") + F.col("_vy")).alias("div"))


#: km of planar_km's plane in a degree to the east and to the north.
EAST_KM, NORTH_KM = 111.2 * math.cos(math.radians(25.0)), 111.2
#: Sides of the squares, in km, by which neighbours are found: each four times the one before, the last wider than the globe.
SIDES = [25.0 * 4**k for k in range(7)]


def _square(lon: str, lat: str, side: Column) -> list[Column]:
    """Column and row of the square of planar_km's plane that a place is in."""
    return [F.floor(F.col(lon) * EAST_KM / side).cast("long"), F.floor(F.col(lat) * NORTH_KM / side).cast("long")]


def _around(df: DataFrame, x: str, y: str) -> DataFrame:
    """A row for each of the nine squares at and around (x, y)."""
    d = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    at = df.select("*", d.alias("_dx")).select("*", d.alias("_dy"))
    return at.withColumns({x: F.col(x) + F.col("_dx"), y: F.col(y) + F.col("_dy")}).drop("_dx", "_dy")


def nearest_distance(df: DataFrame, targets: DataFrame, keys: list[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with the distance in km to the nearest target of the same keys; null without one.

    A place looks for the smallest side whose nine squares around it hold a target at all. The nearest one then is within
    less than three sides, so that the nine squares of the next side, four times as wide, hold it. Targets further away
    aren't met.
    """
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(SIDES)])).alias("_l")
    t = targets.select(*keys, F.col(lon).alias("tx"), F.col(lat).alias("ty")).distinct().select("*", level)
    t = t.select(*keys, "tx", "ty", F.col("_l.k").alias("_k"), *[c.alias(n) for c, n in zip(_square("tx", "ty", F.col("_l.s")), ("_x", "_y"))])
    places = df.select(*keys, lon, lat).distinct()
    seen = places.select("*", level).select(*keys, lon, lat, F.col("_l.k").alias("_k"), *[c.alias(n) for c, n in zip(_square(lon, lat, F.col("_l.s")), ("_x", "_y"))])
    on = [*keys, "_k", "_x", "_y"]
    least = _around(seen, "_x", "_y").join(t.select(*on).distinct(), on, "left_semi").groupBy(*keys, lon, lat).agg(F.min("_k").alias("_k"))
    last = len(SIDES) - 1
    wide = least.withColumn("_k", F.least(F.col("_k") + 1, F.lit(last)))
    side = F.element_at(F.array(*map(F.lit, SIDES)), F.col("_k") + 1)
    asked = _around(wide.select("*", *[c.alias(n) for c, n in zip(_square(lon, lat, side), ("_x", "_y"))]), "_x", "_y")
    d = planar_km(F.col(lon), F.col(lat), F.col("tx"), F.col("ty"))
    near = asked.join(t, on).groupBy(*keys, lon, lat).agg(F.min(d).alias("km"))
    return df.join(near, [*keys, lon, lat], "left")


def near_pairs(a: DataFrame, b: DataFrame, keys: list[str], within: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows of a with rows of b (whose place is lon2, lat2) of the same keys at most within km away, and d, that distance."""
    square = lambda df, x, y: df.select("*", *[c.alias(n) for c, n in zip(_square(x, y, F.lit(within * (1 + 1e-9))), ("_x", "_y"))])
    d = planar_km(F.col(lon), F.col(lat), F.col("lon2"), F.col("lat2"))
    met = _around(square(a, lon, lat), "_x", "_y").join(square(b, "lon2", "lat2"), [*keys, "_x", "_y"])
    return met.where(d <= within).withColumn("d", d).drop("_x", "_y")


def band_products(df: DataFrame, keys: list[str], values: list[str], edges: list[float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """keys, band, pairs and for each value i_<value>: Moran's I of a key's cells by distance band (a, b] for several values at once.

    Cells with all values count. No pair beyond the last edge is formed. With v_i and v_j a pair's values and m the mean,
    the products of deviations are sums of v_i * v_j, v_i + v_j and pairs, so that no mean has to be known before.
    """
    rows = df.where(reduce(Column.__and__, [F.col(v).isNotNull() for v in values])).select(*keys, lon, lat, *values)
    other = rows.select(*keys, F.col(lon).alias("lon2"), F.col(lat).alias("lat2"), *[F.col(v).alias(f"{v}_2") for v in values])
    band = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        band = F.when((F.col("d") > edges[k]) & (F.col("d") <= edges[k + 1]), k).otherwise(band)
    pairs = near_pairs(rows, other, keys, edges[-1], lon, lat).withColumn("band", band).where("band is not null")
    sums = pairs.groupBy(*keys, "band").agg(F.count("*").alias("pairs"), *[x for v in values for x in (F.sum(F.col(v) * F.col(f"{v}_2")).alias(f"_p_{v}"), F.sum(F.col(v) + F.col(f"{v}_2")).alias(f"_s_{v}"))])
    whole = rows.groupBy(*keys).agg(*[x for v in values for x in (F.avg(v).alias(f"_m_{v}"), F.var_pop(v).alias(f"_v_{v}"))])
    out = sums.join(whole, keys) if keys else sums.join(F.broadcast(whole))
    mean = lambda v: (F.col(f"_p_{v}") - F.col(f"_m_{v}") * F.col(f"_s_{v}") + F.col("pairs") * F.col(f"_m_{v}") * F.col(f"_m_{v}")) / F.col("pairs")
    return out.select(*keys, "band", "pairs", *[F.try_divide(mean(v), F.col(f"_v_{v}")).alias(f"i_{v}") for v in values])


def moran_bands(df: DataFrame, keys: list[str], value: str, edges: list[float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """keys, band, pairs, i: Moran's I of the cells of a key by distance band (a, b]."""
    return band_products(df, keys, [value], edges, lon, lat).withColumnRenamed(f"i_{value}", "i")
