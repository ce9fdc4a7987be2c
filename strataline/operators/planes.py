"""Ingest and exchange: windows of days, first of duplicate rows, planes of 16-bit numbers in base64."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def windows(span: DataFrame, first: str, last: str, days: int) -> DataFrame:
    """a, b: the inclusive range first to last in windows of so many days, the last one shorter."""
    a = F.explode(F.sequence(first, last, F.expr(f"interval {days} days"))).alias("a")
    return span.select("*", a).select(*[c for c in span.columns if c not in (first, last)], "a", F.least(F.date_add("a", days - 1), F.col(last)).alias("b"))


def halves(windows_: DataFrame, least: int = 4) -> DataFrame:
    """Windows that failed, each cut in two (a to mid, mid + 1 to b); those of at most least days stay whole."""
    span = F.datediff("b", "a") + 1
    mid = F.date_add("a", (F.floor(span / 2) - 1).cast("int"))
    parts = F.when(span > least, F.array(F.struct(F.col("a"), mid.alias("b")), F.struct(F.date_add(mid, 1).alias("a"), F.col("b")))).otherwise(F.array(F.struct("a", "b")))
    return windows_.select(*[c for c in windows_.columns if c not in ("a", "b")], F.explode(parts).alias("w")).select("*", "w.a", "w.b").drop("w")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows of equal keys the first in order."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def to_plane(df: DataFrame, keys: list[str], place: list[str], value: Column) -> DataFrame:
    """keys, plane: the 16-bit numbers (null: -32768) in the order of place, little-endian, as base64. A plane is one grid."""
    word = F.lower(F.lpad(F.hex(F.coalesce(value, F.lit(-32768)).cast("int").bitwiseAND(65535)), 4, "0"))
    rows = df.select(*keys, F.struct(*place, F.concat(F.substring(word, 3, 2), F.substring(word, 1, 2)).alias("w")).alias("s"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["w"]), "").alias("h")).select(*keys, F.regexp_replace(F.base64(F.unhex("h")), "\\s", "").alias("plane"))


def from_plane(df: DataFrame, keys: list[str], plane: str, scale: float = 100.0) -> DataFrame:
    """keys, at (from 0), value: a plane's numbers again; -32768 is null."""
    at = F.posexplode(F.sequence(F.lit(1), (F.length(F.hex(F.unbase64(plane))) / 4).cast("int")))
    rows = df.select(*keys, F.hex(F.unbase64(plane)).alias("_h"), at.alias("at", "_k"))
    word = F.conv(F.concat(F.substr("_h", F.col("_k") * 4 - 1, F.lit(2)), F.substr("_h", F.col("_k") * 4 - 3, F.lit(2))), 16, 10).cast("int")
    signed = F.when(word > 32767, word - 65536).otherwise(word)
    return rows.select(*keys, "at", F.when(signed != -32768, signed / scale).alias("value"))
