"""Robust trends: median of pairwise slopes and its rank test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_two_sided


def sen_trend(df: DataFrame, keys: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """keys, n, slope, s, z, p for series of least values or more. Pairs are formed within a key only.

    The series are short by nature (one value a year); a key's pairs grow with the square of its length.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    n = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    pairs = rows.join(rows.select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2")), keys).where("x < x2")
    sums = pairs.groupBy(*keys).agg(F.median((F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x"))).alias("slope"), F.sum(F.signum(F.col("y2") - F.col("y"))).cast("long").alias("s"))
    out = sums.join(n, keys)
    sd = F.sqrt(F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) / 18)
    out = out.withColumn("z", F.when(F.col("s") > 0, (F.col("s") - 1) / sd).when(F.col("s") < 0, (F.col("s") + 1) / sd).otherwise(0.0))
    return out.withColumn("p", normal_two_sided(F.col("z")))
