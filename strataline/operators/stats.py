"""Ranks, correlations, selectivity, histograms and order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranks


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 4) -> DataFrame:
    """keys, n, rho, and the t statistic of n - 2 degrees of freedom."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = ranks.with_rank(ranks.with_rank(rows, keys, "_x", "rx"), keys, "_y", "ry")
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")).alias("rho"))
    out = out.withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))
    return out.withColumn("t", F.try_divide(F.col("rho") * F.sqrt(F.col("n") - 2), F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("rho") * F.col("rho")))))


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """keys, n1, n0, auc: area under the receiver's curve, ties counting half; null without both labels. Rows without a score don't count."""
    y = F.col(label).cast("int")
    counts = df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(y).alias("c1"), F.sum(1 - y).alias("c0"))
    out = ranks.running(counts, keys, "_s", ["c0"]).groupBy(*keys).agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"), F.sum(F.col("c1") * (F.col("before_c0") + F.col("c0") / 2)).alias("s"))
    return out.select(*keys, "n1", "n0", F.try_divide(F.col("s"), F.col("n1") * F.col("n0")).alias("auc"))


def ols(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def selectivity(df: DataFrame, keys: list[str], value: str, weight: str, least: int = 10) -> DataFrame:
    """use (mean by weight), avail (plain mean) and (use - avail) / sd, from least rows or more of some weight."""
    rows = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.sum(F.col(value) * F.col(weight)).alias("xw"), F.avg(value).alias("avail"), F.stddev_pop(value).alias("sd"))
    out = out.where((F.col("n") >= least) & (F.col("w") > 0)).withColumn("use", F.col("xw") / F.col("w"))
    return out.select(*keys, "n", "use", "avail", F.try_divide(F.col("use") - F.col("avail"), F.col("sd")).alias("si"))


def use_availability(df: DataFrame, keys: list[str], value: str, weight: str, start: float, width: float) -> DataFrame:
    """Histogram by bin: share of rows, share of weight, and their quotient."""
    rows = df.where(F.col(value).isNotNull())
    bins = rows.groupBy(*keys, F.floor((F.col(value) - start) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    w = Window.partitionBy(*keys)
    out = bins.select(*keys, "bin", (F.col("n") / F.sum("n").over(w)).alias("avail"), F.try_divide(F.col("w"), F.sum("w").over(w)).alias("use"))
    return out.withColumn("q", F.try_divide(F.col("use"), F.col("avail")))


def order_statistics(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], rule: str = "floor_n") -> DataFrame:
    """Values at index floor(n p) ('floor_n'), round(p (n - 1)) ('round') or floor(p (n - 1)) ('floor') of the sorted values.

    Equal values are counted first; running counts then find the value at each index.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    run = ranks.running(counts, keys, "v", ["c"]).withColumn("upto", F.col("before_c") + F.col("c")).withColumnRenamed("all_c", "n")

    def at(p: float) -> Column:
        n = F.col("n")
        i = {"floor_n": F.least(F.floor(n * p), n - 1), "round": F.floor(p * (n - 1) + 0.5), "floor": F.floor(p * (n - 1))}[rule]
        return F.min(F.when(F.col("upto") > i, F.col("v")))

    return run.groupBy(*keys).agg(F.max("n").alias("n"), *[at(p).alias(name) for name, p in shares.items()])


def robust_mean(df: DataFrame, keys: list[str], value: str, within: float, least: int = 3, share: float = 0.3) -> DataFrame:
    """Mean of the values within a distance of their group's median, where enough remain."""
    mid = df.groupBy(*keys).agg(F.median(value).alias("mid"), F.count(value).alias("n"))
    near = F.abs(F.col(value) - F.col("mid")) < within
    out = df.join(mid, keys).groupBy(*keys).agg(F.max("n").alias("n"), F.count_if(near).alias("k"), F.avg(F.when(near, F.col(value))).alias("mean"))
    return out.withColumn("mean", F.when(F.col("k") >= F.greatest(F.lit(least), F.col("n") * share), F.col("mean")))
