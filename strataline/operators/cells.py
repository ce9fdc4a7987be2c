"""Statistics of each cell of a daily field, and the reports built on yearly, monthly and daily means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import climatology, series, trend


def in_years(df: DataFrame, day: str, first: int, last: int) -> DataFrame:
    """Rows of the years first to last, both included (a base period)."""
    return df.where(F.year(day).between(first, last))


def complete_years(df: DataFrame, day: str) -> tuple[int, int]:
    """First and last year that the record covers but for 15 days at either end."""
    a, z = df.agg(F.min(day), F.max(day)).first()
    return a.year + (a.timetuple().tm_yday > 15), z.year - (z.timetuple().tm_yday < 350)


def cell_stats(df: DataFrame, clim: DataFrame, keys: list[str], day: str, v: str, years: tuple[int, int], least_days: int = 300, least_total: int = 600, least_years: int = 10) -> DataFrame:
    """One row per key: mean, trend per decade with p, exceedance days a year (all, early, late, late - early), amp, phase, interannual sd.

    df holds keys, doy, day, v; clim keys, doy, clim, thr. Early years are the first half. Null where support is missing.
    """
    y0, y1 = years
    inside = in_years(df, day, y0, y1)
    annual = series.annual_mean(inside, keys, day, v, least_days).where(F.col("mean").isNotNull())
    slopes = trend.sen_trend(annual, keys, "year", "mean", least_years).select(*keys, (F.col("slope") * 10).alias("trend"), "p")
    spread = annual.groupBy(*keys).agg(F.when(F.count("*") >= least_years, F.stddev_pop("mean")).alias("sd_inter"))
    marked = inside.join(clim.select(*keys, "doy", "thr"), [*keys, "doy"], "left").where(F.col(v).isNotNull() & F.col("thr").isNotNull())
    early = F.year(day) < y0 + (y1 - y0 + 1) // 2
    rate = lambda cond: F.count_if(cond & (F.col(v) > F.col("thr"))) / F.count_if(cond) * 365.25
    support = lambda cond, least: F.when(F.count_if(cond) > least, rate(cond))
    hot = marked.groupBy(*keys).agg(support(F.lit(True), least_total).alias("days"), support(early, least_days).alias("days_early"), support(~early, least_days).alias("days_late"))
    out = df.groupBy(*keys).agg(F.avg(v).alias("mean"))
    for part in (slopes, hot, climatology.amplitude_phase(clim, keys, "doy"), spread):
        out = out.join(part, keys, "left")
    return out.withColumn("delta", F.col("days_late") - F.col("days_early"))


def monthly_cube(df: DataFrame, keys: list[str], day: str, v: str, cells: int, least: int = 10, share: float = 0.2) -> DataFrame:
    """keys, ym, mean: months of more than least days, of months in which more than the share of all cells have one."""
    m = series.monthly(df, keys, day, v, least).where(F.col("mean").isNotNull()).select(*keys, "ym", "mean")
    kept = m.groupBy("ym").agg(F.count("*").alias("n")).where(F.col("n") > share * cells).select("ym")
    return m.join(kept, "ym", "left_semi")


def monthly_clim(monthly: DataFrame, keys: list[str], first: int, last: int, least: int = 3) -> DataFrame:
    """keys, month, clim: mean of the base period's months where more than least have a value."""
    rows = monthly.where(F.substring("ym", 1, 4).cast("int").between(first, last))
    out = rows.groupBy(*keys, F.substring("ym", 6, 2).cast("int").alias("month")).agg(F.count("mean").alias("n"), F.avg("mean").alias("clim"))
    return out.where(F.col("n") > least).drop("n")


def monthly_anomaly(monthly: DataFrame, clim: DataFrame, keys: list[str]) -> DataFrame:
    m = monthly.withColumn("month", F.substring("ym", 6, 2).cast("int")).join(clim, [*keys, "month"], "left")
    return m.withColumn("ano", F.col("mean") - F.col("clim"))


def doy_climatology(df: DataFrame, keys: list[str], v: str, least: int = 3, half: int = 15) -> DataFrame:
    """keys, doy, clim: plain means by day of year of more than least values, then smoothed around the year."""
    plain = df.groupBy(*keys, "doy").agg(F.count(v).alias("n"), F.avg(v).alias("clim")).where(F.col("n") > least).drop("n")
    return climatology.smooth_phase(plain, keys, "doy", ["clim"], half)


def trend_line(annual: DataFrame, keys: list[str], x: str = "year", y: str = "mean", least: int = 10) -> DataFrame:
    """keys, x, y, line: the Sen line through the medians of x and y."""
    rows = annual.where(F.col(y).isNotNull())
    mid = rows.groupBy(*keys).agg(F.median(x).alias("mx"), F.median(y).alias("my"))
    fit = trend.sen_trend(rows, keys, x, y, least).select(*keys, "slope", "p").join(mid, keys)
    return rows.join(fit, keys).select(*keys, x, y, (F.col("my") + F.col("slope") * (F.col(x) - F.col("mx"))).alias("line"), "slope", "p")


def event_days(events: DataFrame, df: DataFrame, keys: list[str], day: str, least: int = 300) -> DataFrame:
    """Event days of every year of df with more than least calendar days; 0 where there are none."""
    days = df.select(*keys, F.col(day).alias("d")).distinct().groupBy(*keys, F.year("d").alias("year")).agg(F.count("*").alias("calendar"))
    hot = events.select(*keys, F.explode(F.sequence("start", "stop", F.expr("interval 1 day"))).alias("d")).groupBy(*keys, F.year("d").alias("year")).agg(F.count("*").alias("hot"))
    return days.join(hot, [*keys, "year"], "left").select(*keys, "year", F.when(F.col("calendar") > least, F.coalesce("hot", F.lit(0))).alias("days"))


def indicators(annual: DataFrame, events: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: warmest and second year, number of events, longest and strongest, days early and late with their ratio."""
    rank = Window.partitionBy(*keys).orderBy(F.desc("mean"), "year")
    top = annual.where(F.col("mean").isNotNull()).withColumn("r", F.row_number().over(rank)).where("r <= 2")
    top = top.groupBy(*keys).agg(F.max(F.when(F.col("r") == 1, F.col("year"))).alias("warmest"), F.max(F.when(F.col("r") == 2, F.col("year"))).alias("second"))
    ev = events.groupBy(*keys).agg(F.count("*").alias("events"), F.max("dur").alias("longest"), F.max_by("start", F.struct("icum", "start")).alias("strongest"), F.count_if(F.col("cat") == 4).alias("extreme"), F.sum("dur").alias("total"))
    half = Window.partitionBy(*keys).orderBy("year")
    d = days.where(F.col("days").isNotNull()).select("*", F.row_number().over(half).alias("r"), F.count("*").over(Window.partitionBy(*keys)).alias("m"))
    early = F.col("r") <= F.floor(F.col("m") / 2)
    d = d.groupBy(*keys).agg(F.avg(F.when(early, F.col("days"))).alias("early"), F.avg(F.when(~early, F.col("days"))).alias("late"))
    return top.join(ev, keys, "left").join(d, keys, "left").withColumn("ratio", F.col("late") / F.greatest(F.lit(0.5), F.col("early")))


def last_years(df: DataFrame, day: str, years: int = 3) -> DataFrame:
    """Rows of the last years of the record, with their year and day of year."""
    last = df.agg(F.max(F.year(day)).alias("last_year"))
    return df.join(F.broadcast(last)).where(F.year(day) > F.col("last_year") - years).select(*df.columns, F.year(day).alias("year"))
