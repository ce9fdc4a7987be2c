"""Vertical profiles: one row per level in, one row per profile out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def profile_metrics(levels: DataFrame, keys: list[str], p: str = "p", t: str = "t", drop: float = 0.5, isotherm: float = 20.0, to: float = 200.0, min_levels: int = 4, top: float = 15.0, bottom: float = 60.0) -> DataFrame:
    """keys, nlev, surface, pmax, mld, thd, thg, iso, mean_to of each profile that has enough levels and depth.

    mld: where t has first fallen by drop below the surface (interpolated); thd, thg: mid-depth and strength (per 100)
    of the steepest fall, the shallower of equal ones; iso: where t first falls through isotherm; mean_to: trapezoid
    mean down to ``to``, where the profile reaches four fifths of it.
    """
    w = Window.partitionBy(*keys).orderBy("p")
    whole = Window.partitionBy(*keys)
    rows = levels.where(F.col(t).isNotNull()).select(*keys, F.col(p).cast("double").alias("p"), F.col(t).cast("double").alias("t"))
    rows = rows.select("*", F.lag("p").over(w).alias("p0"), F.lag("t").over(w).alias("t0"), F.min_by("t", "p").over(whole).alias("ts"), F.max_by("t", "p").over(whole).alias("tb"))
    grad = F.round(-(F.col("t") - F.col("t0")) / (F.col("p") - F.col("p0")), 6)

    def through(level):
        return F.col("p0") + (F.col("p") - F.col("p0")) * (F.col("t0") - level) / (F.col("t0") - F.col("t"))

    goal = F.col("ts") - drop
    fallen = (F.col("t") <= goal) & (F.col("t0") > goal)
    iso = (F.col("t") <= isotherm) & (F.col("t0") > isotherm) & (F.col("ts") >= isotherm) & (F.col("tb") <= isotherm)
    deep = F.max(F.when(F.col("p") <= to, F.col("p")))
    area = F.sum(F.when(F.col("p") <= to, 0.5 * (F.col("t") + F.col("t0")) * (F.col("p") - F.col("p0"))))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("nlev"), F.first("ts").alias("surface"), F.min("p").alias("pmin"), F.max("p").alias("pmax"),
        F.min_by(F.when(fallen, through(goal)), F.when(fallen, F.col("p"))).alias("mld"),
        F.max_by((F.col("p") + F.col("p0")) / 2, F.when(F.col("p0").isNotNull(), F.struct(grad, -F.col("p")))).alias("thd"),
        (F.max(grad) * 100).alias("thg"),
        F.min_by(F.when(iso, through(F.lit(isotherm))), F.when(iso, F.col("p"))).alias("iso"),
        F.when(deep >= 0.8 * to, area / (deep - F.min("p"))).alias("mean_to"),
    )
    return out.where((F.col("nlev") >= min_levels) & (F.col("pmin") <= top) & (F.col("pmax") >= bottom)).drop("pmin")


def transport(df: DataFrame, keys: list[str], v: str, area: str) -> DataFrame:
    """Flow through sections of the given area: forth, back and net."""
    f = F.col(v) * F.col(area) / 1e6
    return df.groupBy(*keys).agg(F.sum(F.when(F.col(v) > 0, f).otherwise(0.0)).alias("forth"), F.sum(F.when(F.col(v) < 0, f).otherwise(0.0)).alias("back"), F.sum(f).alias("net"))


def flow_stability(df: DataFrame, keys: list[str], u: str, v: str) -> DataFrame:
    """Mean components, mean speed, speed of the mean and their ratio, from rows with both components."""
    both = df.where(F.col(u).isNotNull() & F.col(v).isNotNull())
    out = both.groupBy(*keys).agg(F.avg(u).alias("u"), F.avg(v).alias("v"), F.avg(F.hypot(u, v)).alias("speed"))
    return out.withColumn("vec", F.hypot("u", "v")).withColumn("stab", F.when(F.col("speed") > 0, F.col("vec") / F.col("speed")))
