"""Climatologies over a cyclic phase (day of year, hour of day, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def phase_climatology(df: DataFrame, keys: list[str], phase: str, value: str, half: int = 5, cycle: int = 366, q: float = 0.9, least: int = 10) -> DataFrame:
    """keys, phase, n, clim, thr: mean and exact percentile of the values within half phases, around the cycle.

    Values that are equal are counted first, so that the spreading to neighbouring phases works on the counts.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, phase, value).agg(F.count("*").alias("n"))
    spread = counted.withColumn("w", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn(phase, (F.pmod(F.col(phase) + F.col("w") - 1, F.lit(cycle)) + 1).cast("int"))
    out = spread.groupBy(*keys, phase).agg(F.sum("n").alias("n"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("clim"), F.expr(f"percentile(`{value}`, {q}, n)").alias("thr"))
    return out.where(F.col("n") >= least)


def smooth_phase(df: DataFrame, keys: list[str], phase: str, values: list[str], half: int = 15, cycle: int = 366) -> DataFrame:
    """Circular moving means of values; missing phases are filled from their neighbours."""
    spread = df.withColumn("w", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn(phase, (F.pmod(F.col(phase) + F.col("w") - 1, F.lit(cycle)) + 1).cast("int"))
    return spread.groupBy(*keys, phase).agg(*[F.avg(v).alias(v) for v in values])


def anomaly(df: DataFrame, clim: DataFrame, on: list[str], value: str) -> DataFrame:
    """df with clim, thr (null where there are none) and ano."""
    return df.join(clim.select(*on, "clim", "thr"), on, "left").withColumn("ano", F.col(value) - F.col("clim"))


def amplitude_phase(clim: DataFrame, keys: list[str], phase: str) -> DataFrame:
    """Range of clim and the first phase of its maximum."""
    return clim.groupBy(*keys).agg((F.max("clim") - F.min("clim")).alias("amp"), F.max_by(phase, F.struct("clim", -F.col(phase))).alias("phase"))
