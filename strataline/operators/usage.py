"""What activity meets against what there is: monthly series, whether it follows, spread of groups, and trends with their error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import stars, student_two_sided
from . import fishery, stats


def use_series(df: DataFrame, keys: list[str], value: str, weight: str, unit: str) -> DataFrame:
    """keys, use, avail, per_unit: mean by weight, plain mean, and weight for each different unit with some weight."""
    x, w = F.col(value), F.col(weight)
    known = x.isNotNull() & w.isNotNull()
    out = df.groupBy(*keys).agg(F.sum(F.when(known, x * w)).alias("_xw"), F.sum(F.when(known, w)).alias("_w"), F.avg(x).alias("avail"), F.sum(w).alias("_all"), F.count_distinct(F.when(w > 0, F.col(unit))).alias("_units"))
    return out.select(*keys, F.try_divide("_xw", "_w").alias("use"), "avail", F.try_divide("_all", "_units").alias("per_unit"))


def tracking(series: DataFrame, keys: list[str], season: str, avail: str = "avail", use: str = "use") -> DataFrame:
    """keys, n, slope, r, season_slope: the line of what is used over what is available, and that of both less their seasons' means.

    Activity that follows one value has a slope near 0, activity that stays where it is one near 1.
    """
    both = series.where(F.col(avail).isNotNull() & F.col(use).isNotNull())
    w = Window.partitionBy(*keys, season)
    rows = both.select(*keys, F.col(avail).alias("_x"), F.col(use).alias("_y"), (F.col(avail) - F.avg(avail).over(w)).alias("_xs"), (F.col(use) - F.avg(use).over(w)).alias("_ys"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.corr("_y", "_x").alias("r"), F.regr_slope("_ys", "_xs").alias("season_slope"))


def autocorrelated_trend(df: DataFrame, keys: list[str], x: str, y: str, step: float = 1.0, per: float = 10.0, least: int = 5) -> DataFrame:
    """keys, n, slope, ci95, r1, ne, p: least-squares trend of a series, its error by as many values as its autocorrelation leaves.

    r1 is the residuals' autocorrelation between values one step apart (a gap pairs nothing), ne = n (1 - r1) / (1 + r1)
    between 3 and n, slope and ci95 (1.96 standard errors) are for ``per`` steps. Series of fewer than least values have none.
    """
    key = Window.partitionBy(*keys)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    e = F.col("_y") - F.regr_intercept("_y", "_x").over(key) - F.regr_slope("_y", "_x").over(key) * F.col("_x")
    rows = rows.select("*", e.alias("_e"))
    before = key.orderBy("_x")
    rows = rows.select("*", F.when(F.abs(F.col("_x") - F.lag("_x").over(before) - step) < 1e-9, F.col("_e") * F.lag("_e").over(before)).alias("_ee"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("_b"), F.sum(F.col("_e") * F.col("_e")).alias("_sse"), F.sum("_ee").alias("_see"), F.regr_sxx("_y", "_x").alias("_sxx")).where(F.col("n") >= least)
    r1 = F.coalesce(F.try_divide("_see", "_sse"), F.lit(0.0))
    n = F.col("n").cast("double")
    out = out.withColumn("r1", r1).withColumn("ne", F.least(n, F.greatest(F.lit(3.0), n * F.coalesce(F.try_divide(1 - F.col("r1"), 1 + F.col("r1")), F.lit(0.0)))))
    out = out.withColumn("_se", F.sqrt(F.col("_sse") / (F.col("ne") - 2) / F.col("_sxx")))
    t = F.abs("_b") / F.greatest(F.col("_se"), F.lit(1e-300))
    return out.select(*keys, "n", (F.col("_b") * per).alias("slope"), (1.96 * F.col("_se") * per).alias("ci95"), "r1", "ne", student_two_sided(t, F.col("ne") - 2).alias("p"))


def group_spread(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, p25, p50, p75, apart: a group's quartiles and how far its median is from that of all rows."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias(group), F.col(value).alias(value))
    every = rows.select(F.lit(0).alias("_all"), value)
    mid = stats.order_statistics(every, ["_all"], value, {"_mid": 0.5}).select("_mid")  # one row
    out = stats.order_statistics(rows, [group], value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return out.join(F.broadcast(mid)).select(group, "n", "p25", "p50", "p75", (F.col("p50") - F.col("_mid")).alias("apart"))


def near_share(df: DataFrame, keys: list[str], distance: str, weight: str, within: float) -> DataFrame:
    """keys, use, avail: share of weight and share of rows at most within a distance, of the rows that have one."""
    near = F.col(distance) <= within
    out = df.where(F.col(distance).isNotNull()).groupBy(*keys).agg(F.sum(F.when(near, F.col(weight)).otherwise(0)).alias("_near"), F.sum(weight).alias("_all"), (F.count_if(near) / F.count("*")).alias("avail"))
    return out.select(*keys, F.try_divide("_near", "_all").alias("use"), "avail")


def selectivity_map(df: DataFrame, keys: list[str], values: list[str], weight: str, edges: list[float], below: float = 0.05) -> DataFrame:
    """keys, variable, n, si, rho, ne, p, star, stars: selectivity for each variable, and whether its rank correlation with weight holds.

    df has lon and lat; the correlation is that of log(1 + weight), with the degrees of freedom autocorrelation leaves.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in values])).alias("_v")
    rows = df.select(*keys, "lon", "lat", F.col(weight).alias("_w"), pairs).select(*keys, "lon", "lat", "_w", "_v.variable", "_v.x").where("x IS NOT NULL")
    own = [*keys, "variable"]
    chosen = stats.selectivity(rows, own, "x", "_w").select(*own, "n", "si")
    tied = fishery.corrected_correlation(rows.withColumn("_lw", F.log1p("_w")), own, "x", "_lw", edges).drop("n")
    star: Column = F.coalesce(F.col("p") < below, F.lit(False))
    return chosen.join(tied, own, "left").select(*own, "n", "si", "rho", "ne", "p", star.alias("star"), stars(F.col("p")).alias("stars"))
