"""Yearly folders that new rows are merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.planes import first_of
from ..operators.steps import settled


def merge_years(new: DataFrame, path: str, keys: list[str], day: str = "day", order: list[str] | None = None) -> DataFrame:
    """Merges rows into Parquet under path, partitioned by year: of rows of one key and day the first stays.

    What is there already comes first, then new rows by order. Only the years of new rows are read and written again, each
    as a whole, so that a run that is repeated, or that broke off, changes nothing that stood there.
    """
    spark = new.sparkSession
    sc = spark.sparkContext
    new = new.withColumn("year", F.year(day))
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    rows = new.withColumn("_new", F.lit(1))
    if at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at):
        years = [r.year for r in new.select("year").distinct().collect()]
        rows = spark.read.parquet(path).where(F.col("year").isin(years)).withColumn("_new", F.lit(0)).unionByName(rows)
    kept = settled(first_of(rows, [*keys, day], ["_new", *(order or [])]).drop("_new"))  # before the folder it comes from is written
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    return spark.read.parquet(path)
