"""Series over days: weighted means, years, months, pentads, centred means on a full calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean of value by weight over the rows that have one."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(w)).alias(value))


def calendar(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Every day from a key's first to its last, with the values of df where there are any."""
    span = df.groupBy(*keys).agg(F.min(day).alias("a"), F.max(day).alias("z"))
    return span.select(*keys, F.explode(F.sequence("a", "z", F.expr("interval 1 day"))).alias(day)).join(df, [*keys, day], "left")


def centred_mean(dense: DataFrame, keys: list[str], day: str, value: str, width: int, share: float = 0.6, out: str = "smooth") -> DataFrame:
    """Mean of width rows around each; null unless all rows exist and more than the share of them have a value."""
    ahead = width // 2
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-(width - 1 - ahead), ahead)
    enough = (F.count("*").over(w) == width) & (F.count(value).over(w) > share * width)
    return dense.withColumn(out, F.when(enough, F.avg(value).over(w)))


def annual_mean(df: DataFrame, keys: list[str], day: str, value: str, least: int = 300) -> DataFrame:
    return df.groupBy(*keys, F.year(day).alias("year")).agg(F.count(value).alias("n"), F.when(F.count(value) > least, F.avg(value)).alias("mean"))


def pentads(df: DataFrame, keys: list[str], day: str, value: str, width: int = 5) -> DataFrame:
    """Means of blocks of width days counted from the first day of all."""
    first = df.agg(F.min(day).alias("day0"))
    block = F.floor(F.datediff(F.col(day), F.col("day0")) / width).cast("long")
    return df.join(F.broadcast(first)).groupBy(*keys, block.alias("block")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def monthly(df: DataFrame, keys: list[str], day: str, value: str, least: int = 10) -> DataFrame:
    return df.groupBy(*keys, F.date_format(day, "yyyy-MM").alias("ym")).agg(F.when(F.count(value) > least, F.avg(value)).alias("mean"), F.count(value).alias("n"))


def month_table(df: DataFrame, day: str, value: str) -> DataFrame:
    return df.groupBy(F.month(day).alias("month")).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))


def year_month_matrix(df: DataFrame, day: str, value: str, least: int = 10) -> DataFrame:
    """A row for each year, a column m1 to m12 for each month's mean (of least values or more), and the row's mean."""
    months = list(range(1, 13))
    cells = df.groupBy(F.year(day).alias("year"), F.month(day).alias("m")).agg(F.when(F.count(value) >= least, F.avg(value)).alias("x"))
    wide = cells.groupBy("year").pivot("m", months).agg(F.first("x"))
    mean = cells.groupBy("year").agg(F.avg("x").alias("row_mean"))
    return wide.join(mean, "year").select("year", *[F.col(str(m)).alias(f"m{m}") for m in months], "row_mean")


def hovmoeller(df: DataFrame, day: str, row: str, col: str, value: str, least: int = 0) -> DataFrame:
    """Means along rows and along columns by day, in one pass: axis ('row' or 'col'), band, day, mean, n."""
    spread = df.withColumn("b", F.explode(F.array(F.struct(F.lit("row").alias("axis"), F.col(row).alias("band")), F.struct(F.lit("col").alias("axis"), F.col(col).alias("band")))))
    return spread.groupBy("b.axis", "b.band", day).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).where(F.col("n") > least)
