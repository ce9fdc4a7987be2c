"""Profiles and flow over regions: interpolation, layers, nearest levels, sections and contours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def at_level(levels: DataFrame, keys: list[str], p: str, value: str, level: float, clamp: bool = True) -> DataFrame:
    """keys, value: linear interpolation at a level; beyond the ends the end's value (clamp) or null."""
    rows = levels.where(F.col(value).isNotNull()).select(*keys, F.col(p).alias("p"), F.col(value).alias("x"))
    up, down = F.col("p") <= level, F.col("p") >= level
    out = rows.groupBy(*keys).agg(
        F.max(F.when(up, F.col("p"))).alias("pa"), F.max_by(F.when(up, F.col("x")), F.when(up, F.col("p"))).alias("xa"),
        F.min(F.when(down, F.col("p"))).alias("pb"), F.min_by(F.when(down, F.col("x")), F.when(down, F.col("p"))).alias("xb"),
    )
    inside = F.when(F.col("pa") == F.col("pb"), F.col("xa")).otherwise(F.col("xa") + (F.col("xb") - F.col("xa")) * (level - F.col("pa")) / (F.col("pb") - F.col("pa")))
    return out.select(*keys, (F.coalesce(inside, "xa", "xb") if clamp else inside).alias(value))


def density_difference(levels: DataFrame, keys: list[str], p: str, sigma: str, to: float = 100.0, least: int = 4, top: float = 15.0) -> DataFrame:
    """keys, dsig: density at ``to`` less that at 0, of profiles with enough levels that reach from top to ``to``."""
    fit = levels.where(F.col(sigma).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(p).alias("a"), F.max(p).alias("z"))
    fit = fit.where((F.col("n") >= least) & (F.col("a") <= top) & (F.col("z") >= to)).select(*keys)
    deep = at_level(levels, keys, p, sigma, to).withColumnRenamed(sigma, "deep")
    return fit.join(deep, keys).join(at_level(levels, keys, p, sigma, 0.0), keys).select(*keys, (F.col("deep") - F.col(sigma)).alias("dsig"))


def stability(levels: DataFrame, keys: list[str], p: str, sigma: str, least: int = 3) -> DataFrame:
    """keys, n2max, zn2: the largest 9.81 / 1025 dsigma/dz of neighbouring levels and its mid-depth, the shallower of equal ones."""
    w = Window.partitionBy(*keys).orderBy(p)
    rows = levels.where(F.col(sigma).isNotNull()).select(*keys, F.col(p).alias("p"), (F.round((F.col(sigma) - F.lag(sigma).over(w)) / (F.col(p) - F.lag(p).over(w)) * 9.81 / 1025, 12)).alias("n2"), ((F.col(p) + F.lag(p).over(w)) / 2).alias("mid"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("n2").alias("n2max"), F.max_by("mid", F.when(F.col("n2").isNotNull(), F.struct("n2", -F.col("p")))).alias("zn2"))
    return out.where(F.col("n") >= least).drop("n")


def mixed_layer(levels: DataFrame, keys: list[str], p: str, t: str, reference: float = 10.0, drop: float = 0.5) -> DataFrame:
    """keys, mld, bottom: the first level below the reference that is colder than it by drop, without interpolation; else the deepest, flagged.

    A profile that doesn't reach up to the reference has nothing to be colder than.
    """
    rows = levels.where(F.col(t).isNotNull())
    ref = at_level(rows, keys, p, t, reference, clamp=False).withColumnRenamed(t, "ref")
    out = rows.join(ref, keys).groupBy(*keys).agg(F.min(F.when((F.col(p) > reference) & (F.col(t) < F.col("ref") - drop), F.col(p))).alias("first"), F.max(p).alias("deepest"))
    return out.select(*keys, F.coalesce("first", "deepest").alias("mld"), F.col("first").isNull().alias("bottom"))


def nearest_level(levels: DataFrame, keys: list[str], p: str, level: float) -> DataFrame:
    """Each key's row at the level nearest to the wanted one, the shallower of equally near ones."""
    best = levels.groupBy(*keys).agg(F.min_by(F.struct(*levels.columns), F.struct(F.abs(F.col(p) - level), F.col(p))).alias("_r"))
    return best.select("_r.*")


def layer_bounds(levels: DataFrame, keys: list[str], p: str) -> DataFrame:
    """levels with top and base: midpoints to the neighbours; the first layer begins at 0, the last ends at its level."""
    w = Window.partitionBy(*keys).orderBy(p)
    return levels.select("*", F.coalesce((F.col(p) + F.lag(p).over(w)) / 2, F.lit(0.0)).alias("top"), F.coalesce((F.col(p) + F.lead(p).over(w)) / 2, F.col(p)).alias("base"))


def common_cells(df: DataFrame, cell: list[str], period: str, value: str, periods: list[int]) -> DataFrame:
    """Rows of cells that have a value in every one of the periods."""
    full = df.where(F.col(period).isin(*periods) & F.col(value).isNotNull()).groupBy(*cell).agg(F.count_distinct(period).alias("n")).where(F.col("n") == len(periods)).select(*cell)
    return df.join(full, cell, "left_semi")


def region_stats(metrics: DataFrame, keys: list[str], names: list[str], weight: str) -> DataFrame:
    """Means of each metric by weight, each over the rows that have it."""
    return metrics.groupBy(*keys).agg(F.count("*").alias("ncell"), *[(F.sum(F.col(m) * F.col(weight)) / F.sum(F.when(F.col(m).isNotNull(), F.col(weight)))).alias(m) for m in names])


def zero_crossings(df: DataFrame, keys: list[str], x: str, v: str) -> DataFrame:
    """keys, at: where v becomes positive or ceases to be between neighbours in x, by linear interpolation."""
    w = Window.partitionBy(*keys).orderBy(x)
    rows = df.where(F.col(v).isNotNull()).select(*keys, F.col(x).alias("x1"), F.col(v).alias("v1"), F.lag(x).over(w).alias("x0"), F.lag(v).over(w).alias("v0"))
    return rows.where("(v0 > 0) <> (v1 > 0)").select(*keys, (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("v0") / (F.col("v0") - F.col("v1"))).alias("at"))


def strongest_axis(df: DataFrame, keys: list[str], x: str, speed: str, least: float = 0.5) -> DataFrame:
    """keys, x, speed: where the flow is fastest, the smallest x of equally fast ones, if it reaches least."""
    out = df.where(F.col(speed).isNotNull()).groupBy(*keys).agg(F.max_by(x, F.struct(F.col(speed), -F.col(x))).alias(x), F.max(speed).alias(speed))
    return out.where(F.col(speed) >= least)


def observed_span(df: DataFrame, keys: list[str], i: str, value: str) -> DataFrame:
    """df cut to the positions from one before the first value to one after the last."""
    span = df.where(F.col(value).isNotNull()).groupBy(*keys).agg((F.min(i) - 1).alias("_a"), (F.max(i) + 1).alias("_z"))
    return df.join(span, keys).where(F.col(i).between(F.col("_a"), F.col("_z"))).drop("_a", "_z")


def contour_segments(df: DataFrame, keys: list[str], row: str, col: str, value: str, level: float) -> DataFrame:
    """keys, row, col, x0, y0, x1, y1: contour segments in the squares of a lattice (row, col: the square's lower left corner).

    A square's edges are crossed where its ends lie on both sides of the level; two crossings give a segment, four give
    two, in the order of the edges below, right, above, left. Squares with a missing corner give none.
    """
    by_col, by_row = Window.partitionBy(*keys, row).orderBy(col), Window.partitionBy(*keys, col).orderBy(row)
    next_to = lambda c, w, along: F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead(c).over(w))
    g = df.select(*keys, F.col(row).alias("j"), F.col(col).alias("i"), F.col(value).alias("a"), next_to(value, by_col, col).alias("b"), next_to(value, by_row, row).alias("d"))
    up = Window.partitionBy(*keys, "i").orderBy("j")
    g = g.select("*", F.when(F.lead("j").over(up) == F.col("j") + 1, F.lead("b").over(up)).alias("c")).dropna(subset=["a", "b", "c", "d"])

    def crossed(p: str, q: str, x: Column, y: Column) -> Column:
        return F.when((F.col(p) >= level) != (F.col(q) >= level), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))

    t = lambda p, q: (level - F.col(p)) / (F.col(q) - F.col(p))
    j, i = F.col("j"), F.col("i")
    edges = F.array(crossed("a", "b", i + t("a", "b"), j), crossed("b", "c", i + 1, j + t("b", "c")), crossed("d", "c", i + t("d", "c"), j + 1), crossed("a", "d", i, j + t("a", "d")))
    g = g.withColumn("e", F.filter(edges, lambda e: e.isNotNull())).where(F.size("e") >= 2)
    pairs = F.when(F.size("e") == 4, F.array(F.slice("e", 1, 2), F.slice("e", 3, 2))).otherwise(F.array(F.slice("e", 1, 2)))
    s = g.select(*keys, "j", "i", F.explode(pairs).alias("s"))
    return s.select(*keys, F.col("j").alias(row), F.col("i").alias(col), F.col("s")[0]["x"].alias("x0"), F.col("s")[0]["y"].alias("y0"), F.col("s")[1]["x"].alias("x1"), F.col("s")[1]["y"].alias("y1"))
