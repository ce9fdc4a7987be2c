"""Profile tables in CSV: the kind is told from the header, values snap to the grid, levels and periods to their lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Fixed column names of the two kinds of files.
CTD = {"pressure(db)": "p", "temp_avg(deg.c)": "t", "temp_std(deg.c)": "tsd", "sal_avg(psu)": "s", "sigma-t_avg(kg/m3)": "sg"}
ADCP = {"depth(m)": "z", "u_avg(m/s)": "u", "v_avg(m/s)": "v", "speed(m/s)": "spd", "u_std(m/s)": "usd", "v_std(m/s)": "vsd"}
MISSING = ["", "null", "nan", "na"]


def read_profiles(
    spark: SparkSession, path: str, levels: list[float], periods: list[int], lon0: float = 116.0, lat0: float = 18.0, nlon: int = 49, nlat: int = 57, step: float = 0.25,
    scales: dict[str, int] | None = None, counts: Observation | None = None,
) -> DataFrame:
    """period, j, i, lon, lat, the level and the value columns present; rows off the grid, levels or periods go.

    Positions are the first two columns. Tokens of MISSING in any case are null. Of rows of one place, level and period
    each column keeps its last value that isn't null, files in the order of their names. scales (steps to the unit, by
    column) rounds values to what 16 bits of fixed point hold; a value beyond them counts as missing. counts observes
    rows, those read, and kept, those within grid, levels and periods.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path).select("*", "_metadata.file_path", "_metadata.file_block_start")
    raw = raw.toDF(*[c.replace("\ufeff", "").strip().lower() for c in raw.columns[:-2]], "_file", "_block")
    names = CTD if "pressure(db)" in raw.columns else ADCP
    level = next(iter(names.values()))
    number = lambda c: F.when(~F.lower(F.trim(F.col(f"`{c}`"))).isin(*MISSING), F.trim(F.col(f"`{c}`")).try_cast("double"))

    def value(c: str, n: str):
        q = F.round(number(c) * (scales or {}).get(n, 1))
        return F.when(F.abs(q) <= 32767, q / scales[n]) if n in (scales or {}) else number(c)

    x, y = raw.columns[:2]
    given = {n: c for c, n in names.items() if c in raw.columns}
    df = raw.select(number("time_period").cast("int").alias("period"), number(x).alias("x"), number(y).alias("y"), *[value(c, n).alias(n) for n, c in given.items()], F.struct("_file", "_block", F.monotonically_increasing_id().alias("row")).alias("_at"))
    df = df.withColumn("i", F.floor((F.col("x") - lon0) / step + 0.5).cast("int")).withColumn("j", F.floor((F.col("y") - lat0) / step + 0.5).cast("int"))
    inside = F.coalesce(F.col("i").between(0, nlon - 1) & F.col("j").between(0, nlat - 1) & F.col(level).isin(*levels) & F.col("period").isin(*periods), F.lit(False))
    df = df.observe(counts, F.count("*").alias("rows"), F.count_if(inside).alias("kept")) if counts else df
    place = ["period", "j", "i", level]
    last = df.where(inside).groupBy(*place).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_at"))).alias(n) for n in given if n != level])
    return last.select("period", "j", "i", (lon0 + step * F.col("i")).alias("lon"), (lat0 + step * F.col("j")).alias("lat"), *given)
