"""Warm spells: runs of days above a threshold, merged over short gaps, with their strength."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spells(df: DataFrame, keys: list[str], day: str, value: str, shortest: int = 5, gap: int = 2) -> DataFrame:
    """keys, start, stop: runs of value > thr on consecutive days of at least shortest days, then merged over gaps of up to gap days.

    df holds keys, day, value and thr; a missing value or threshold is no exceedance.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    hot = df.where(F.col(value) > F.col("thr")).select(*keys, F.col(day).alias("d"))
    hot = hot.withColumn("run", F.date_sub("d", F.row_number().over(Window.partitionBy(*keys).orderBy("d"))))
    runs = hot.groupBy(*keys, "run").agg(F.min("d").alias(day), F.max("d").alias("stop"), F.count("*").alias("n")).where(F.col("n") >= shortest)
    runs = runs.withColumn("new", F.when(F.datediff(day, F.lag("stop").over(w)) - 1 <= gap, 0).otherwise(1))
    runs = runs.withColumn("event", F.sum("new").over(w))
    return runs.groupBy(*keys, "event").agg(F.min(day).alias("start"), F.max("stop").alias("stop")).drop("event")


def spell_metrics(events: DataFrame, df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Duration, highest, mean and summed anomaly, and category 1 to 4 of each event; df holds clim and thr too."""
    inside = events.withColumn(day, F.explode(F.sequence("start", "stop", F.expr("interval 1 day")))).join(df.select(*keys, day, value, "clim", "thr"), [*keys, day], "left")
    ano = F.col(value) - F.col("clim")
    ratio = F.when(F.col("thr") > F.col("clim"), ano / (F.col("thr") - F.col("clim")))
    return inside.groupBy(*keys, "start", "stop").agg(
        F.count("*").alias("dur"), F.max(ano).alias("imax"), F.avg(ano).alias("imean"), F.sum(ano).alias("icum"), F.greatest(F.lit(1), F.least(F.lit(4), F.floor(F.max(ratio)))).cast("int").alias("cat")
    )


def spell_days_per_year(events: DataFrame, keys: list[str]) -> DataFrame:
    days = events.select(*keys, F.explode(F.sequence("start", "stop", F.expr("interval 1 day"))).alias("d"))
    return days.groupBy(*keys, F.year("d").alias("year")).agg(F.count("*").alias("days"))


def exceedance_rate(df: DataFrame, keys: list[str], value: str, least: int = 300) -> DataFrame:
    """Days above thr in a year of 365.25 days, from those with a value and a threshold."""
    valid = F.count_if(F.col(value).isNotNull() & F.col("thr").isNotNull())
    return df.groupBy(*keys).agg(valid.alias("n"), F.when(valid > least, F.count_if(F.col(value) > F.col("thr")) / valid * 365.25).alias("days_per_year"))


def on_days(df: DataFrame, events: DataFrame, keys: list[str], day: str) -> DataFrame:
    """df with event, the first day of the event that a day lies in, null outside; events of a key don't overlap."""
    own = events.select(*keys, F.col("start").alias("event"), F.explode(F.sequence("start", "stop", F.expr("interval 1 day"))).alias(day))
    return df.join(own, [*keys, day], "left")
