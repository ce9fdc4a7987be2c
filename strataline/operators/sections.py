"""Sections through an atlas: their layers, trimmed span and colour range, flow through them, and panels of single nodes.

Sections are a table of (section, the row they follow, first, last, deepest), a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hydro, stats


def selected(levels: DataFrame, sections: DataFrame, row: str, along: str, level: str) -> DataFrame:
    """section, deepest and the columns of levels, for levels within a section."""
    s = sections.select("section", F.col(row).alias("_row"), "first", "last", "deepest")
    inside = (F.col(row) == F.col("_row")) & F.col(along).between(F.col("first"), F.col("last")) & (F.col(level) <= F.col("deepest"))
    return levels.join(s, inside).select("section", "deepest", *levels.columns)


def section_report(levels: DataFrame, sections: DataFrame, keys: list[str], row: str, along: str, level: str, value: str, symmetric: bool = False) -> DataFrame:
    """section, keys, along, level, value, top, base, lo, hi, shade.

    Layers reach from midpoint to midpoint of the section's levels, from 0 to the last level. The colours' range lo to hi
    are the values at 2 and 98 % of the section's values of those keys, or as far below 0 as above it (symmetric); shade
    is the value's place in it, 0 to 1, null where the range is empty. Places run from one before the first value to one
    after the last.
    """
    own = ["section", *keys]
    cut = selected(levels, sections, row, along, level)
    layers = hydro.layer_bounds(cut.select(*own, level).distinct(), own, level)
    span = stats.order_statistics(cut, own, value, {"lo": 0.02, "hi": 0.98}, "round").select(*own, "lo", "hi")
    if symmetric:
        wide = F.greatest(F.abs("lo"), F.abs("hi"))
        span = span.select(*own, (-wide).alias("lo"), wide.alias("hi"))
    out = hydro.observed_span(cut, own, along, value).join(layers, [*own, level]).join(span, own)
    shade = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo"))))
    known = F.col(value).isNotNull() & (F.col("hi") > F.col("lo"))
    return out.select(*own, along, level, value, "top", "base", "lo", "hi", F.when(known, shade).alias("shade"))


def section_transport(levels: DataFrame, sections: DataFrame, period: str, row: str, along: str, level: str, v: str, area: Column, common: list[int]) -> DataFrame:
    """section, period, cells, north, south, net, net_common, common: flow in millions through cells of the given area.

    net_common is over the cells that have a value in every one of the common periods, as only those compare periods.
    """
    cut = selected(levels, sections, row, along, level).where(F.col(v).isNotNull()).withColumn("_f", F.col(v) * area / 1e6)
    place = ["section", row, along, level]
    # what the rows of a place have in all is bounded by the periods
    full = cut.where(F.col(period).isin(*common)).groupBy(*place).agg((F.count_distinct(period) == len(common)).alias("_full"))
    f, full_ = F.col("_f"), F.coalesce("_full", F.lit(False))
    out = cut.join(full, place, "left").groupBy("section", period).agg(
        F.count("*").alias("cells"), F.sum(F.when(f > 0, f).otherwise(0.0)).alias("north"), F.sum(F.when(f < 0, f).otherwise(0.0)).alias("south"), F.sum("_f").alias("net"),
        F.sum(F.when(full_, f).otherwise(0.0)).alias("net_common"), F.count_if(full_).alias("common"),
    )
    return out


def panels(levels: DataFrame, node: list[str], level: str, t: str, u: str, v: str, deepest: float = 300.0) -> DataFrame:
    """node, depth, t_lo, t_hi, reach: the axes of a node's profile panels.

    The depth axis ends at the next 50 below the deepest level with a value, from 50 to deepest; temperatures reach from
    the whole degree below to that above, null without any; flow from -reach to reach, at least 0.3.
    """
    some = F.col(t).isNotNull() | F.col(u).isNotNull() | F.col(v).isNotNull()
    out = levels.groupBy(*node).agg(F.max(F.when(some, F.col(level))).alias("_z"), F.floor(F.min(t)).alias("t_lo"), F.ceil(F.max(t)).alias("t_hi"), F.max(F.greatest(F.abs(F.col(u)), F.abs(F.col(v)))).alias("_r"))
    depth = F.least(F.lit(deepest), F.ceil(F.greatest(F.lit(50.0), F.col("_z")) / 50) * 50.0)
    return out.where("_z is not null").select(*node, depth.alias("depth"), "t_lo", "t_hi", F.greatest(F.lit(0.3), F.col("_r")).alias("reach"))


def coast(df: DataFrame, keys: list[str], row: str, col: str, land: str) -> DataFrame:
    """keys, row, col of land with sea above, below, left or right of it; cells without all four neighbours are none."""
    # every cell tells its four neighbours what it is, so that no row of the lattice has to stand in one task
    side = F.explode(F.array(*[F.struct(F.lit(dj).alias("dj"), F.lit(di).alias("di")) for dj, di in ((-1, 0), (1, 0), (0, -1), (0, 1))])).alias("s")
    told = df.select(*keys, row, col, land, side).select(*keys, (F.col(row) + F.col("s.dj")).cast("int").alias(row), (F.col(col) + F.col("s.di")).cast("int").alias(col), F.lit(None).cast("boolean").alias("_own"), F.col(land).alias("_near"))
    own = df.select(*keys, F.col(row).cast("int").alias(row), F.col(col).cast("int").alias(col), F.col(land).alias("_own"), F.lit(None).cast("boolean").alias("_near"))
    met = own.unionByName(told).groupBy(*keys, row, col).agg(F.max("_own").alias("_own"), F.min("_near").alias("_near"), F.count("_near").alias("_n"))
    return met.where("_own AND NOT _near AND _n = 4").select(*keys, row, col)
