"""Reports over the daily field of order lines: what was shipped on each day by six groups of suppliers, which stand on a
lattice of two rows and three columns. Values are means of whole cents, so that no order of adding changes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cells, climatology, events, series, spatial, stats
from .climate import R, SHIFT, _clim_sql, _r, _t
from .registry import register

BASE, YEARS, LEAST_YEARS, SHORTEST = (1996, 1999), (1995, 2000), 5, 1
REGIONS = [("west", 116.0, 116.5, 18.0, 20.0), ("south", 116.0, 118.0, 18.0, 18.2), ("all", 116.0, 118.0, 18.0, 20.0)]


def cube(spark: SparkSession, d: str) -> DataFrame:
    """cell, j, i, lat, lon, day, doy, v: every day from the first shipment to the last for each cell, null where it has none."""
    sold = _t(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), (F.col("l_suppkey") % 6).cast("int").alias("cell"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    mean = sold.groupBy("cell", "day").agg((F.sum("cents") / F.count("*") / 100000).alias("v"))
    span = sold.agg(F.explode(F.sequence(F.min("day"), F.max("day"), F.expr("interval 1 day"))).alias("day"))
    days = span.select("day", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("cell")).join(mean, ["cell", "day"], "left")
    return days.selectExpr("cell", "cell div 3 AS j", "cell % 3 AS i", "18.125D + 0.25D * (cell div 3) AS lat", "116.125D + 0.25D * (cell % 3) AS lon", "day", "dayofyear(day) AS doy", "v")


_CUBE = """sold AS (SELECT l_shipdate::DATE AS day, (l_suppkey % 6)::INT AS cell, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem),
    cube AS MATERIALIZED (SELECT cell, cell // 3 AS j, cell % 3 AS i, 18.125::DOUBLE + 0.25::DOUBLE * (cell // 3) AS lat, 116.125::DOUBLE + 0.25::DOUBLE * (cell % 3) AS lon, day, dayofyear(day)::INT AS doy, v
    FROM (SELECT day, unnest(range(6))::INT AS cell FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM sold))
    LEFT JOIN (SELECT cell, day, sum(cents)::DOUBLE / count(*) / 100000 AS v FROM sold GROUP BY 1, 2) USING (cell, day))"""
_BASE = f"base AS (SELECT * FROM cube WHERE v IS NOT NULL AND year(day) BETWEEN {BASE[0]} AND {BASE[1]})"
_CLIM = f"{_CUBE}, {_BASE}, {_clim_sql('base', 'cell')}"
_T = "(1 / (1 + 0.2316419 * abs(z)))"
_P = f"2 * {_T} * (0.319381530 + {_T} * (-0.356563782 + {_T} * (1.781477937 + {_T} * (-1.821255978 + {_T} * 1.330274429)))) * exp(-z * z / 2) * 0.3989422804014327"


def _sen_sql(src: str, key: str, x: str, y: str, name: str) -> str:
    return f"""{name} AS (SELECT *, {_P} AS p FROM (SELECT {key}, slope, CASE WHEN s > 0 THEN s - 1 WHEN s < 0 THEN s + 1 ELSE 0 END / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) AS z
    FROM (SELECT a.{key}, median((b.{y} - a.{y}) / (b.{x} - a.{x})) AS slope, sum(sign(b.{y} - a.{y})) AS s FROM {src} a JOIN {src} b ON a.{key} = b.{key} AND a.{x} < b.{x} GROUP BY 1)
    JOIN (SELECT {key}, count(*) AS n FROM {src} GROUP BY 1 HAVING count(*) >= {LEAST_YEARS}) USING ({key})))"""


def _clim(spark, d):
    c = cube(spark, d)
    return c, climatology.phase_climatology(cells.in_years(c, "day", *BASE), ["cell"], "doy", "v")


_STATS = f"""{_CLIM}, full_years AS (SELECT * FROM cube WHERE year(day) BETWEEN {YEARS[0]} AND {YEARS[1]}),
    annual AS (SELECT cell, year(day) AS year, avg(v) AS mean FROM full_years GROUP BY 1, 2 HAVING count(v) > 300), {_sen_sql('annual', 'cell', 'year', 'mean', 'sen')},
    sd AS (SELECT cell, CASE WHEN count(*) >= {LEAST_YEARS} THEN stddev_pop(mean) END AS sd_inter FROM annual GROUP BY 1),
    hot AS (SELECT cell, CASE WHEN count(*) > 600 THEN count(*) FILTER (v > thr) / count(*) * 365.25 END AS days,
      CASE WHEN count(*) FILTER (year(day) < 1998) > 300 THEN count(*) FILTER (v > thr AND year(day) < 1998) / count(*) FILTER (year(day) < 1998) * 365.25 END AS days_early,
      CASE WHEN count(*) FILTER (year(day) >= 1998) > 300 THEN count(*) FILTER (v > thr AND year(day) >= 1998) / count(*) FILTER (year(day) >= 1998) * 365.25 END AS days_late
      FROM full_years JOIN clim USING (cell, doy) WHERE v IS NOT NULL GROUP BY 1),
    amp AS (SELECT cell, max(clim) - min(clim) AS amp, arg_max(doy, (round(clim, 6), -doy)) AS phase FROM clim GROUP BY 1),
    stats AS (SELECT cell, mean, slope * 10 AS trend, p, days, days_early, days_late, days_late - days_early AS delta, amp, phase::INT AS phase, sd_inter FROM (SELECT cell, avg(v) AS mean FROM cube GROUP BY 1)
      LEFT JOIN sen USING (cell) LEFT JOIN hot USING (cell) LEFT JOIN amp USING (cell) LEFT JOIN sd USING (cell))"""
_STAT_COLS = ["mean", "trend", "p", "days", "days_early", "days_late", "delta", "amp", "sd_inter"]


def _stats(spark, d):
    c, clim = _clim(spark, d)
    years = cells.complete_years(c, "day")
    return cells.cell_stats(c, clim.withColumn("clim", F.round("clim", 6)), ["cell"], "day", "v", years, least_years=LEAST_YEARS)


@register("cell_stats", f"WITH {_STATS} SELECT cell, phase, {', '.join(R(x, x, 3) for x in _STAT_COLS)} FROM stats")
def cell_stats(spark, d):
    return _r(_stats(spark, d), 3)


@register(
    "cell_summary",
    f"""WITH {_STATS}, x AS (SELECT list(trend ORDER BY trend) AS t, count(*)::BIGINT AS n, (count(*) FILTER (p < 0.05))::BIGINT AS significant FROM stats WHERE trend IS NOT NULL)
    SELECT n, significant, {R('t[1]', 'least', 3)}, {R('t[least(floor(n * 0.05)::BIGINT, n - 1) + 1]', 'p5', 3)}, {R('t[least(floor(n * 0.5)::BIGINT, n - 1) + 1]', 'p50', 3)}, {R('t[least(floor(n * 0.95)::BIGINT, n - 1) + 1]', 'p95', 3)}, {R('t[n]', 'most', 3)} FROM x WHERE n > 0""",
)
def cell_summary(spark, d):
    s = _stats(spark, d).where(F.col("trend").isNotNull()).withColumn("all", F.lit(0))
    order = stats.order_statistics(s, ["all"], "trend", {"least": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "most": 1.0})
    return _r(order.join(s.groupBy("all").agg(F.count_if(F.col("p") < 0.05).alias("significant")), "all").drop("all"), 3)


_MONTHLY = f"""{_CUBE}, m0 AS (SELECT cell, j, i, strftime(day, '%Y-%m') AS ym, avg(v) AS mean FROM cube GROUP BY 1, 2, 3, 4 HAVING count(v) > 10),
    monthly AS (SELECT *, substr(ym, 6, 2)::INT AS month FROM m0 WHERE ym IN (SELECT ym FROM m0 GROUP BY 1 HAVING count(*) > 1.2)),
    mclim AS (SELECT cell, month, avg(mean) AS clim FROM monthly WHERE substr(ym, 1, 4)::INT BETWEEN {BASE[0]} AND {BASE[1]} GROUP BY 1, 2 HAVING count(mean) > 3)"""


def _monthly(spark, d):
    m = cells.monthly_cube(cube(spark, d), ["cell", "j", "i"], "day", "v", 6)
    return m, cells.monthly_clim(m, ["cell"], *BASE)


@register("monthly_field", f"WITH {_MONTHLY} SELECT cell, ym, {R('mean', 'mean')}, {R('clim', 'clim')}, {R('mean - clim', 'ano')} FROM monthly LEFT JOIN mclim USING (cell, month)")
def monthly_field(spark, d):
    m, clim = _monthly(spark, d)
    return _r(cells.monthly_anomaly(m, clim, ["cell"]).select("cell", "ym", "mean", "clim", "ano"))


@register(
    "cell_history",
    f"WITH {_MONTHLY} SELECT cell, ym, {R('mean', 'mean')}, CASE WHEN count(*) OVER w = 12 AND count(mean) OVER w > 0.6 * 12 THEN {R('avg(mean) OVER w', 'x').removesuffix(' AS x')} END AS smooth FROM monthly WINDOW w AS (PARTITION BY cell ORDER BY ym ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)",
)
def cell_history(spark, d):
    return _r(series.centred_mean(_monthly(spark, d)[0].select("cell", "ym", "mean"), ["cell"], "ym", "mean", 12))


_BOXES = "boxes(region, lon0, lon1, lat0, lat1) AS (VALUES " + ", ".join(f"('{n}', {a}, {b}, {c}, {e})" for n, a, b, c, e in REGIONS) + ")"
_W = "cos(radians(lat))"
_REGION = f"""{_CLIM}, {_BOXES}, bridge AS (SELECT region, cell, {_W} AS w FROM (SELECT DISTINCT cell, lat, lon FROM cube) JOIN boxes ON lon BETWEEN lon0 AND lon1 AND lat BETWEEN lat0 AND lat1),
    rclim AS (SELECT region, doy, sum(clim * w) / sum(w) AS clim, sum(thr * w) / sum(w) AS thr FROM clim JOIN bridge USING (cell) GROUP BY 1, 2),
    daily AS (SELECT *, v - clim AS ano FROM (SELECT region, day, any_value(doy) AS doy, sum(v * w) / sum(w) FILTER (v IS NOT NULL) AS v FROM cube JOIN bridge USING (cell) GROUP BY 1, 2) LEFT JOIN rclim USING (region, doy)),
    annual AS (SELECT region, year(day) AS year, avg(v) AS mean FROM daily WHERE year(day) BETWEEN {YEARS[0]} AND {YEARS[1]} GROUP BY 1, 2 HAVING count(v) > 300)"""


def _regions(spark, d):
    """region, day, doy, v, clim, thr, ano; and the regions' climatology."""
    c, clim = _clim(spark, d)
    boxes = spark.createDataFrame(REGIONS, "region string, lon0 double, lon1 double, lat0 double, lat1 double")
    bridge = F.broadcast(spatial.in_boxes(c.select("cell", "lat", "lon").distinct(), boxes).select("cell", "region", scalars.area_weight(F.col("lat")).alias("w")))  # cells x boxes
    daily = series.weighted_mean(c.select("cell", "day", "doy", "v").join(bridge, "cell"), ["region", "day", "doy"], "v", "w")
    both = clim.join(bridge, "cell").groupBy("region", "doy").agg(*[(F.sum(F.col(x) * F.col("w")) / F.sum("w")).alias(x) for x in ("clim", "thr")])
    return climatology.anomaly(daily, both, ["region", "doy"], "v"), both


@register(
    "region_days",
    f"WITH {_REGION} SELECT region, day, {R('v', 'v')}, {R('ano', 'ano')}, CASE WHEN count(*) OVER w = 365 AND count(ano) OVER w > 0.6 * 365 THEN {R('avg(ano) OVER w', 'x').removesuffix(' AS x')} END AS smooth FROM daily WINDOW w AS (PARTITION BY region ORDER BY day ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)",
)
def region_days(spark, d):
    return _r(series.centred_mean(_regions(spark, d)[0].select("region", "day", "v", "ano"), ["region"], "day", "ano", 365))


@register("annual_cycle", f"WITH {_REGION} SELECT region, year(day)::INT AS year, doy, {R('v', 'v')}, {R('clim', 'clim')}, {R('thr', 'thr')} FROM daily WHERE year(day) > (SELECT max(year(day)) - 3 FROM cube)")
def annual_cycle(spark, d):
    return _r(cells.last_years(_regions(spark, d)[0], "day").select("region", "year", "doy", "v", "clim", "thr"))


def _annual(spark, d):
    days = _regions(spark, d)[0]
    a = series.annual_mean(cells.in_years(days, "day", *cells.complete_years(cube(spark, d), "day")), ["region"], "day", "v")
    return days, a.where(F.col("mean").isNotNull())


@register(
    "region_trends",
    f"""WITH {_REGION}, {_sen_sql('annual', 'region', 'year', 'mean', 'sen')}, mid AS (SELECT region, median(year) AS mx, median(mean) AS my FROM annual GROUP BY 1)
    SELECT region, year::INT AS year, {R('mean', 'mean')}, {R('my + slope * (year - mx)', 'line')}, {R('slope', 'slope')}, {R('p', 'p')}, dense_rank() OVER (ORDER BY slope DESC)::INT AS place FROM annual JOIN sen USING (region) JOIN mid USING (region)""",
)
def region_trends(spark, d):
    from pyspark.sql.window import Window

    lines = cells.trend_line(_annual(spark, d)[1], ["region"], least=LEAST_YEARS)
    # one row for each region: a handful
    place = lines.select("region", "slope").distinct().withColumn("place", F.dense_rank().over(Window.orderBy(F.desc("slope"))))
    return _r(lines.join(place.drop("slope"), "region"))


_EVENTS = f"""{_REGION}, hot AS (SELECT region, day, day - row_number() OVER (PARTITION BY region ORDER BY day)::INT AS run FROM daily WHERE v > thr),
    runs AS (SELECT region, min(day) AS a, max(day) AS z FROM hot GROUP BY region, run HAVING count(*) >= {SHORTEST}),
    flagged AS (SELECT *, CASE WHEN a - lag(z) OVER (PARTITION BY region ORDER BY a) - 1 <= 2 THEN 0 ELSE 1 END AS new FROM runs),
    spells AS (SELECT region, min(a) AS start, max(z) AS stop FROM (SELECT *, sum(new) OVER (PARTITION BY region ORDER BY a) AS e FROM flagged) GROUP BY region, e),
    found AS (SELECT region, start, stop, count(*)::BIGINT AS dur, round(max(v - clim) + {SHIFT:.8f}::DOUBLE, 2) + 0.0 AS imax, round(avg(v - clim) + {SHIFT:.8f}::DOUBLE, 2) + 0.0 AS imean, round(sum(v - clim) + {SHIFT:.8f}::DOUBLE, 1) + 0.0 AS icum,
      greatest(1, least(4, floor(max(CASE WHEN thr > clim THEN (v - clim) / (thr - clim) END))))::INT AS cat
      FROM (SELECT region, start, stop, unnest(generate_series(start, stop, INTERVAL 1 DAY))::DATE AS day FROM spells) LEFT JOIN daily USING (region, day) GROUP BY 1, 2, 3)"""


def _events(spark, d):
    days = _regions(spark, d)[0]
    found = events.spell_metrics(events.spells(days, ["region"], "day", "v", shortest=SHORTEST), days, ["region"], "day", "v")
    return days, found.select("region", "start", "stop", "dur", *[(F.round(F.col(c) + SHIFT, n) + F.lit(0.0)).alias(c) for c, n in (("imax", 2), ("imean", 2), ("icum", 1))], "cat")


@register("region_events", f"WITH {_EVENTS} SELECT *, row_number() OVER (PARTITION BY region ORDER BY icum DESC, start)::INT AS place FROM found")
def region_events(spark, d):
    from pyspark.sql.window import Window

    return _events(spark, d)[1].withColumn("place", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("icum"), "start")))


_EVENT_DAYS = f"""{_EVENTS}, per_year AS (SELECT region, year, CASE WHEN calendar > 300 THEN coalesce(hot, 0)::BIGINT END AS days FROM (SELECT region, year(day)::INT AS year, count(*) AS calendar FROM daily GROUP BY 1, 2)
    LEFT JOIN (SELECT region, year(day)::INT AS year, count(*) AS hot FROM (SELECT region, unnest(generate_series(start, stop, INTERVAL 1 DAY))::DATE AS day FROM spells) GROUP BY 1, 2) USING (region, year))"""


@register("region_event_days", f"WITH {_EVENT_DAYS} SELECT region, year, days FROM per_year")
def region_event_days(spark, d):
    days, found = _events(spark, d)
    return cells.event_days(found, days, ["region"], "day")


@register(
    "region_indicators",
    f"""WITH {_EVENT_DAYS}, top AS (SELECT region, max(year) FILTER (r = 1)::INT AS warmest, max(year) FILTER (r = 2)::INT AS second FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY mean DESC, year) AS r FROM annual) GROUP BY 1),
    e AS (SELECT region, count(*)::BIGINT AS events, max(dur) AS longest, arg_max(start, (icum, start)) AS strongest, (count(*) FILTER (cat = 4))::BIGINT AS extreme, sum(dur)::BIGINT AS total FROM found GROUP BY 1),
    h AS (SELECT region, avg(days) FILTER (r <= m // 2) AS early, avg(days) FILTER (r > m // 2) AS late FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY year) AS r, count(*) OVER (PARTITION BY region) AS m FROM per_year WHERE days IS NOT NULL) GROUP BY 1)
    SELECT region, warmest, second, events, longest, strongest, extreme, total, {R('early', 'early')}, {R('late', 'late')}, {R('late / greatest(0.5, early)', 'ratio')} FROM top LEFT JOIN e USING (region) LEFT JOIN h USING (region)""",
)
def region_indicators(spark, d):
    annual = _annual(spark, d)[1]
    days, found = _events(spark, d)
    return _r(cells.indicators(annual, found, cells.event_days(found, days, ["region"], "day"), ["region"]))


@register("month_anomalies", f"WITH {_REGION} SELECT region, month(day)::INT AS month, {R('avg(v)', 'mean')}, {R('min(v)', 'least')}, {R('max(v)', 'most')}, {R('avg(ano)', 'ano')}, count(v)::BIGINT AS n FROM daily GROUP BY 1, 2")
def month_anomalies(spark, d):
    g = _regions(spark, d)[0].groupBy("region", F.month("day").alias("month"))
    return _r(g.agg(F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("ano").alias("ano"), F.count("v").alias("n")))


@register(
    "year_month_anomalies",
    f"WITH {_REGION}, m AS (SELECT year(day)::INT AS year, month(day) AS m, CASE WHEN count(ano) >= 10 THEN avg(ano) END AS x FROM daily WHERE region = 'all' GROUP BY 1, 2) SELECT year, "
    + ", ".join(R(f"max(x) FILTER (m = {k})", f"m{k}") for k in range(1, 13))
    + f", {R('avg(x)', 'row_mean')} FROM m GROUP BY year",
)
def year_month_anomalies(spark, d):
    return _r(series.year_month_matrix(_regions(spark, d)[0].where("region = 'all'"), "day", "ano"))


@register(
    "hovmoeller_pentads",
    f"""WITH {_CUBE}, hov AS (SELECT j AS band, day, any_value(doy) AS doy, avg(v) AS mean FROM cube GROUP BY 1, 2 HAVING count(v) > 1),
    plain AS (SELECT band, doy, avg(mean) AS c FROM hov WHERE year(day) BETWEEN {BASE[0]} AND {BASE[1]} GROUP BY 1, 2 HAVING count(mean) > 3),
    smooth AS (SELECT band, p AS doy, avg(c) AS clim FROM (SELECT band, c, ((doy + w - 1 + 366) % 366) + 1 AS p FROM plain, (SELECT unnest(generate_series(-15, 15)) AS w)) GROUP BY 1, 2),
    pent AS (SELECT band, (day - (SELECT min(day) FROM hov)) // 5 AS block, avg(mean) AS mean FROM hov GROUP BY 1, 2)
    SELECT band::INT AS band, block::BIGINT AS block, {R('mean', 'mean')}, {R('mean - clim', 'ano')} FROM pent LEFT JOIN smooth s ON s.band = pent.band AND s.doy = dayofyear((SELECT min(day) FROM hov) + (block * 5 + 2)::INT)""".replace("SELECT band::INT AS band", "SELECT pent.band::INT AS band"),
)
def hovmoeller_pentads(spark, d):
    hov = series.hovmoeller(cube(spark, d), "day", "j", "i", "v", 1).where("axis = 'row'").select("band", "day", "mean").withColumn("doy", F.dayofyear("day"))
    clim = cells.doy_climatology(cells.in_years(hov, "day", *BASE), ["band"], "mean")
    first = F.broadcast(hov.agg(F.min("day").alias("day0")))  # one row
    pent = series.pentads(hov, ["band"], "day", "mean").join(first).withColumn("doy", F.dayofyear(F.date_add("day0", (F.col("block") * 5 + 2).cast("int"))))
    return _r(pent.join(clim, ["band", "doy"], "left").select(F.col("band").cast("int").alias("band"), "block", "mean", (F.col("mean") - F.col("clim")).alias("ano")))


@register(
    "hovmoeller_months",
    f"""WITH {_MONTHLY}, b AS (SELECT j AS band, ym, any_value(month) AS month, avg(mean) AS x FROM monthly GROUP BY 1, 2 HAVING count(mean) > 2),
    c AS (SELECT j AS band, month, avg(clim) AS y FROM mclim JOIN (SELECT DISTINCT cell, j FROM cube) USING (cell) GROUP BY 1, 2 HAVING count(clim) > 2) SELECT band::INT AS band, ym, {R('x', 'mean')}, {R('x - y', 'ano')} FROM b LEFT JOIN c USING (band, month)""",
)
def hovmoeller_months(spark, d):
    m, clim = _monthly(spark, d)
    band = lambda df, keys, x, n: df.groupBy(F.col("j").alias("band"), *keys).agg(F.count(x).alias("n"), F.avg(x).alias(x)).where(F.col("n") > n).drop("n")
    mean = band(m, ["ym"], "mean", 2).withColumn("month", F.substring("ym", 6, 2).cast("int"))
    own = band(clim.join(m.select("cell", "j").distinct(), "cell"), ["month"], "clim", 2)
    return _r(mean.join(own, ["band", "month"], "left").select(F.col("band").cast("int").alias("band"), "ym", "mean", (F.col("mean") - F.col("clim")).alias("ano")))
