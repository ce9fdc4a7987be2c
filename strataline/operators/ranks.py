"""Running sums and ranks within keys, without a key's rows in one task.

The values' range is cut at a few quantiles. Rows of a key within one cut stand in one task, where sums run; the cuts'
totals, at most one for each cut and key, give what came before. Equal values are counted into one row first, so that a
frequent value is no hot one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _cut(df: DataFrame, value: str) -> Column:
    """Which cut a value is in; as many as Spark has shuffle partitions, of about as many rows each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = sorted(set(df.select(F.col(value).cast("double").alias("_v")).approxQuantile("_v", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    return F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col(value).cast("double"))) if ends else F.lit(0)


def running(df: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """df with before_<s>, the sum of s over the key's smaller values, and all_<s>, that over all; one row for each key and value.

    Null values aren't counted: leave them out. Null keys are keys like others.
    """
    parts = df.withColumn("_cut", _cut(df, value))
    totals = parts.groupBy(*keys, "_cut").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    key = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
    earlier = key.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    at = [F.col(c).alias(f"_k{n}") for n, c in enumerate([*keys, "_cut"])]
    offsets = totals.select(*at, *[x for s in sums for x in (F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}"), F.sum(f"_t_{s}").over(key).alias(f"all_{s}"))])
    here = Window.partitionBy(*keys, "_cut").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select("*", *[F.coalesce(F.sum(s).over(here), F.lit(0)).alias(f"_l_{s}") for s in sums])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate([*keys, "_cut"])])
    return local.join(offsets, same).select(*[f"`{c}`" for c in df.columns], *[x for s in sums for x in ((F.col(f"_l_{s}") + F.col(f"_o_{s}")).alias(f"before_{s}"), f"all_{s}")])


def distinct_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, rank (the mean of its rows' ranks), count: a row for each distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("count"))
    return running(counts, keys, value, ["count"]).select(*keys, value, (F.col("before_count") + (F.col("count") + 1) / 2).alias("rank"), "count")


def with_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """df with the average rank of value within keys; rows without a value have none."""
    ranks = distinct_ranks(df, keys, value).select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate([*keys, value])], F.col("rank").alias(out))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate([*keys, value])])
    return df.join(ranks, same, "left").select(*[f"`{c}`" for c in df.columns], out)
