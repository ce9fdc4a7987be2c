"""Streaming forms (an extension): means over fixed windows and warm runs by session, both with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_mean(stream: DataFrame, keys: list[str], ts: str, value: str, width: str = "5 days", late: str = "1 hour") -> DataFrame:
    w = F.window(ts, width)
    out = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select(F.col("w.start").alias("start"), *keys, "mean", "n")


def hot_sessions(stream: DataFrame, keys: list[str], ts: str, value: str, above: float, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Runs of values above a level that lie no more than gap apart."""
    hot = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).where(F.col(value) > above)
    out = hot.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.max(value).alias("most"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n", "most")
