"""The fixed queries, over the tables at hand: orders by day are the daily field, nations a 5 x 5 lattice of cells,
parts' brands and sizes profiles and levels, discounts and taxes a flow. Each stands with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import climatology, events, profile, series, spatial, stats, trend
from .registry import register


SHIFT = 3.7e-7


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded for reports, without negative zeros. SHIFT keeps means that end in a 5 from rounding either way."""
    return df.select(*[(F.round(F.col(c) + SHIFT, places) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def daily(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("v"))


def daily_cells(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    df = o.groupBy(F.to_date("o_orderdate").alias("day"), F.col("c_nationkey").alias("cell")).agg(F.avg("o_totalprice").alias("v"))
    return df.select("*", *_lattice(F.col("cell")))


def _lattice(cell: Column) -> list[Column]:
    j, i = F.floor(cell / 5).cast("int"), (cell % 5).cast("int")
    return [j.alias("j"), i.alias("i"), (18.0 + 3 * j).alias("lat"), (116.0 + 3 * i).alias("lon")]


DAILY = "daily AS (SELECT o_orderdate::DATE AS day, avg(o_totalprice) AS v FROM orders GROUP BY 1)"
LATTICE = "c // 5 AS j, c % 5 AS i, 18.0::DOUBLE + 3 * (c // 5) AS lat, 116.0::DOUBLE + 3 * (c % 5) AS lon"
CELLS = f"cells AS (SELECT *, {LATTICE.replace('c ', 'cell ')} FROM (SELECT o_orderdate::DATE AS day, c_nationkey AS cell, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))"


def _clim_sql(src: str, keys: str, name: str = "clim") -> str:
    k = keys + ", " if keys else ""
    return f"""{name} AS (SELECT {k}doy, count(*) AS n, avg(v) AS clim, quantile_cont(v, 0.9) AS thr FROM (
      SELECT {k}v, ((dayofyear(day) + w - 1 + 366) % 366) + 1 AS doy FROM {src}, (SELECT unnest(generate_series(-5, 5)) AS w)) GROUP BY {k}doy HAVING count(*) >= 10)"""


R = lambda x, a, n=4: f"round(({x}) + {SHIFT:.8f}::DOUBLE, {n}) + 0.0 AS {a}"


def _doy() -> Column:
    return F.dayofyear("day").cast("int")


def _daily_clim(spark, d):
    df = daily(spark, d).withColumn("doy", _doy())
    return df, climatology.phase_climatology(df, [], "doy", "v")


@register("climatology_daily", f"WITH {DAILY}, {_clim_sql('daily', '')} SELECT doy::INT AS doy, n::BIGINT AS n, {R('clim', 'clim')}, {R('thr', 'thr')} FROM clim")
def climatology_daily(spark, d):
    return _r(_daily_clim(spark, d)[1])


@register("climatology_cells", f"WITH {CELLS}, {_clim_sql('cells', 'cell')} SELECT cell, doy::INT AS doy, n::BIGINT AS n, {R('clim', 'clim')}, {R('thr', 'thr')} FROM clim")
def climatology_cells(spark, d):
    return _r(climatology.phase_climatology(daily_cells(spark, d).withColumn("doy", _doy()), ["cell"], "doy", "v"))


@register(
    "climatology_smooth",
    f"""WITH {DAILY}, {_clim_sql('daily', '')} SELECT p::INT AS doy, {R('avg(clim)', 'clim')}, {R('avg(thr)', 'thr')} FROM (
    SELECT clim, thr, ((doy + w - 1 + 366) % 366) + 1 AS p FROM clim, (SELECT unnest(generate_series(-15, 15)) AS w)) GROUP BY p""",
)
def climatology_smooth(spark, d):
    return _r(climatology.smooth_phase(_daily_clim(spark, d)[1], [], "doy", ["clim", "thr"]))


@register(
    "amplitude_phase",
    f"WITH {CELLS}, {_clim_sql('cells', 'cell')} SELECT cell, {R('max(clim) - min(clim)', 'amp', 3)}, arg_max(doy, (round(clim, 6), -doy))::INT AS phase FROM clim GROUP BY cell",
)
def amplitude_phase(spark, d):
    clim = climatology.phase_climatology(daily_cells(spark, d).withColumn("doy", _doy()), ["cell"], "doy", "v").withColumn("clim", F.round("clim", 6))
    return _r(climatology.amplitude_phase(clim, ["cell"], "doy"), 3)


_MARKED = f"{DAILY}, {_clim_sql('daily', '')}, marked AS (SELECT d.day, d.v, c.clim, c.thr FROM daily d LEFT JOIN clim c ON c.doy = dayofyear(d.day))"
_SPELLS = f"""{_MARKED}, hot AS (SELECT day, day - row_number() OVER (ORDER BY day)::INT AS run FROM marked WHERE v > thr),
    runs AS (SELECT min(day) AS a, max(day) AS z FROM hot GROUP BY run HAVING count(*) >= 2),
    flagged AS (SELECT *, CASE WHEN a - lag(z) OVER (ORDER BY a) - 1 <= 2 THEN 0 ELSE 1 END AS new FROM runs),
    spells AS (SELECT min(a) AS start, max(z) AS stop FROM (SELECT *, sum(new) OVER (ORDER BY a) AS e FROM flagged) GROUP BY e)"""


def _spells(spark, d):
    df, clim = _daily_clim(spark, d)
    marked = climatology.anomaly(df, clim, ["doy"], "v").withColumn("all", F.lit(0))
    return marked, events.spells(marked, ["all"], "day", "v", shortest=2)


@register(
    "events_daily",
    f"""WITH {_SPELLS} SELECT start, stop, count(*)::BIGINT AS dur, {R('max(v - clim)', 'imax', 2)}, {R('avg(v - clim)', 'imean', 2)}, {R('sum(v - clim)', 'icum', 1)},
    greatest(1, least(4, floor(max(CASE WHEN thr > clim THEN (v - clim) / (thr - clim) END))))::INT AS cat
    FROM (SELECT start, stop, unnest(generate_series(start, stop, INTERVAL 1 DAY))::DATE AS day FROM spells) LEFT JOIN marked USING (day) GROUP BY 1, 2""",
)
def events_daily(spark, d):
    marked, found = _spells(spark, d)
    out = events.spell_metrics(found, marked, ["all"], "day", "v")
    return out.select("start", "stop", "dur", *[(F.round(F.col(c) + SHIFT, n) + F.lit(0.0)).alias(c) for c, n in (("imax", 2), ("imean", 2), ("icum", 1))], "cat")


@register("event_days_per_year", f"WITH {_SPELLS} SELECT year(day)::INT AS year, count(*)::BIGINT AS days FROM (SELECT unnest(generate_series(start, stop, INTERVAL 1 DAY))::DATE AS day FROM spells) GROUP BY 1")
def event_days_per_year(spark, d):
    return events.spell_days_per_year(_spells(spark, d)[1], ["all"]).select("year", "days")


@register(
    "exceedance_rate",
    f"""WITH {CELLS}, {_clim_sql('cells', 'cell')} SELECT cell, count(thr)::BIGINT AS n, CASE WHEN count(thr) > 100 THEN {R('count(*) FILTER (v > thr) / count(thr) * 365.25', 'x').removesuffix(' AS x')} END AS days_per_year
    FROM (SELECT c.cell, c.v, m.thr FROM cells c LEFT JOIN clim m ON m.cell = c.cell AND m.doy = dayofyear(c.day)) GROUP BY cell""",
)
def exceedance_rate(spark, d):
    df = daily_cells(spark, d).withColumn("doy", _doy())
    clim = climatology.phase_climatology(df, ["cell"], "doy", "v")
    return _r(events.exceedance_rate(climatology.anomaly(df, clim, ["cell", "doy"], "v"), ["cell"], "v", 100))


BOXES = [("west", 116.0, 119.0, 18.0, 30.0), ("south", 116.0, 128.0, 18.0, 21.0), ("middle", 119.0, 125.0, 21.0, 27.0), ("all", 116.0, 128.0, 18.0, 30.0)]
_BOX_SQL = "boxes(region, lon0, lon1, lat0, lat1) AS (VALUES " + ", ".join(f"('{n}', {a}, {b}, {c}, {e})" for n, a, b, c, e in BOXES) + ")"


@register(
    "region_series",
    f"WITH {CELLS}, {_BOX_SQL} SELECT region, day, {R('sum(v * cos(radians(lat))) / sum(cos(radians(lat)))', 'v')} FROM cells JOIN boxes ON lon BETWEEN lon0 AND lon1 AND lat BETWEEN lat0 AND lat1 GROUP BY 1, 2",
)
def region_series(spark, d):
    boxes = spark.createDataFrame(BOXES, "region string, lon0 double, lon1 double, lat0 double, lat1 double")
    grid = spark.range(25).select(F.col("id").cast("int").alias("cell"), *_lattice(F.col("id"))).select("cell", "lat", "lon")
    bridge = spatial.in_boxes(grid, boxes).select("cell", "region", scalars.area_weight(F.col("lat")).alias("w"))
    df = daily_cells(spark, d).select("day", "cell", "v").join(F.broadcast(bridge), "cell")  # at most boxes x 25 rows
    return _r(series.weighted_mean(df, ["region", "day"], "v", "w"))


@register("annual_means", f"WITH {DAILY} SELECT year(day)::INT AS year, count(v)::BIGINT AS n, CASE WHEN count(v) > 300 THEN {R('avg(v)', 'x').removesuffix(' AS x')} END AS mean FROM daily GROUP BY 1")
def annual_means(spark, d):
    return _r(series.annual_mean(daily(spark, d), [], "day", "v"))


@register("pentads", f"WITH {DAILY} SELECT ((day - (SELECT min(day) FROM daily)) // 5)::BIGINT AS block, {R('avg(v)', 'mean')}, count(v)::BIGINT AS n FROM daily GROUP BY 1")
def pentads(spark, d):
    return _r(series.pentads(daily(spark, d), [], "day", "v"))


@register("monthly_cells", f"WITH {CELLS} SELECT cell, strftime(day, '%Y-%m') AS ym, CASE WHEN count(v) > 3 THEN {R('avg(v)', 'x').removesuffix(' AS x')} END AS mean, count(v)::BIGINT AS n FROM cells GROUP BY 1, 2")
def monthly_cells(spark, d):
    return _r(series.monthly(daily_cells(spark, d), ["cell"], "day", "v", 3))


@register("month_table", f"WITH {DAILY} SELECT month(day)::INT AS month, {R('avg(v)', 'mean')}, {R('min(v)', 'least')}, {R('max(v)', 'most')}, count(v)::BIGINT AS n FROM daily GROUP BY 1")
def month_table(spark, d):
    return _r(series.month_table(daily(spark, d), "day", "v"))


@register(
    "year_month_matrix",
    f"WITH {DAILY}, m AS (SELECT year(day)::INT AS year, month(day) AS m, CASE WHEN count(v) >= 10 THEN avg(v) END AS x FROM daily GROUP BY 1, 2) SELECT year, "
    + ", ".join(R(f"max(x) FILTER (m = {k})", f"m{k}") for k in range(1, 13))
    + f", {R('avg(x)', 'row_mean')} FROM m GROUP BY year",
)
def year_month_matrix(spark, d):
    return _r(series.year_month_matrix(daily(spark, d), "day", "v"))


@register(
    "hovmoeller",
    f"WITH {CELLS} SELECT CASE WHEN grouping(j) = 0 THEN 'row' ELSE 'col' END AS axis, coalesce(j, i)::INT AS band, day, {R('avg(v)', 'mean')}, count(v)::BIGINT AS n FROM cells GROUP BY GROUPING SETS ((day, j), (day, i)) HAVING count(v) > 0",
)
def hovmoeller(spark, d):
    return _r(series.hovmoeller(daily_cells(spark, d), "day", "j", "i", "v"))


@register(
    "centred_mean",
    f"""WITH {DAILY}, dense AS (SELECT g.day, v FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM daily) g LEFT JOIN daily USING (day))
    SELECT day, {R('v', 'v')}, CASE WHEN count(*) OVER w = 31 AND count(v) OVER w > 0.6 * 31 THEN {R('avg(v) OVER w', 'x').removesuffix(' AS x')} END AS smooth FROM dense WINDOW w AS (ORDER BY day ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)""",
)
def centred_mean(spark, d):
    df = daily(spark, d).withColumn("all", F.lit(0))
    return _r(series.centred_mean(series.calendar(df, ["all"], "day"), ["all"], "day", "v", 31).drop("all"))


_SEN = f"""{CELLS}, m AS (SELECT cell, year(day) * 12 + month(day) AS x, round(avg(v), 6) AS y FROM cells GROUP BY 1, 2),
    k AS (SELECT cell, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 10),
    s AS (SELECT a.cell, median((b.y - a.y) / (b.x - a.x)) AS slope, sum(sign(b.y - a.y))::BIGINT AS s FROM m a JOIN m b ON a.cell = b.cell AND a.x < b.x GROUP BY 1),
    z AS (SELECT s.*, k.n, CASE WHEN s > 0 THEN s - 1 WHEN s < 0 THEN s + 1 ELSE 0 END / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) AS z FROM s JOIN k USING (cell))"""
_T = "(1 / (1 + 0.2316419 * abs(z)))"


@register(
    "sen_trend",
    f"""WITH {_SEN} SELECT cell, {R('slope', 'slope')}, s, n::BIGINT AS n, {R('z', 'z')},
    {R(f'2 * {_T} * (0.319381530 + {_T} * (-0.356563782 + {_T} * (1.781477937 + {_T} * (-1.821255978 + {_T} * 1.330274429)))) * exp(-z * z / 2) * 0.3989422804014327', 'p')} FROM z""",
)
def sen_trend(spark, d):
    m = daily_cells(spark, d).groupBy("cell", (F.year("day") * 12 + F.month("day")).alias("x")).agg(F.round(F.avg("v"), 6).alias("y"))
    return _r(trend.sen_trend(m, ["cell"], "x", "y"))


@register(
    "profile_metrics",
    f"""WITH l AS (SELECT p_brand AS brand, p_size::DOUBLE AS p, round(avg(p_retailprice) + 0.00000037, 2) AS t FROM part GROUP BY 1, 2),
    g AS (SELECT *, lag(p) OVER w AS p0, lag(t) OVER w AS t0, first(t) OVER (PARTITION BY brand ORDER BY p) AS ts FROM l WINDOW w AS (PARTITION BY brand ORDER BY p)),
    h AS (SELECT *, last(t) OVER (PARTITION BY brand ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tb, round(-(t - t0) / (p - p0), 6) AS gr FROM g),
    i AS (SELECT *, t <= ts - 50 AND t0 > ts - 50 AS fell, t <= 1400 AND t0 > 1400 AND ts >= 1400 AND tb <= 1400 AS cross FROM h)
    SELECT brand, count(*)::BIGINT AS nlev, {R('first(ts)', 'surface')}, max(p) AS pmax, {R('arg_min(p0 + (p - p0) * (t0 - (ts - 50)) / (t0 - t), p) FILTER (fell)', 'mld')},
      {R('arg_max((p + p0) / 2, (gr, -p)) FILTER (p0 IS NOT NULL)', 'thd')}, {R('max(gr) * 100', 'thg')}, {R('arg_min(p0 + (p - p0) * (t0 - 1400) / (t0 - t), p) FILTER ("cross")', 'iso')},
      CASE WHEN max(p) FILTER (p <= 40) >= 0.8 * 40 THEN {R('(sum(0.5 * (t + t0) * (p - p0)) FILTER (p <= 40)) / (max(p) FILTER (p <= 40) - min(p))', 'x').removesuffix(' AS x')} END AS mean_to
    FROM i GROUP BY brand HAVING count(*) >= 4 AND min(p) <= 15 AND max(p) >= 30""".replace("AS cross FROM h", 'AS "cross" FROM h'),
)
def profile_metrics(spark, d):
    levels = _t(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("p")).agg(F.round(F.avg("p_retailprice") + SHIFT, 2).alias("t"))
    return _r(profile.profile_metrics(levels, ["brand"], drop=50.0, isotherm=1400.0, to=40.0, bottom=30.0))


@register(
    "flow_stability",
    f"""SELECT l_returnflag, l_linestatus, {R('u', 'u')}, {R('v', 'v')}, {R('speed', 'speed')}, {R('sqrt(u * u + v * v)', 'vec')}, {R('CASE WHEN speed > 0 THEN sqrt(u * u + v * v) / speed END', 'stab')} FROM (
    SELECT l_returnflag, l_linestatus, avg(l_discount - 0.05::DOUBLE) AS u, avg(l_tax - 0.04::DOUBLE) AS v, avg(sqrt((l_discount - 0.05::DOUBLE) ** 2 + (l_tax - 0.04::DOUBLE) ** 2)) AS speed FROM lineitem GROUP BY 1, 2)""",
)
def flow_stability(spark, d):
    df = _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_discount") - 0.05).alias("u"), (F.col("l_tax") - 0.04).alias("v"))
    return _r(profile.flow_stability(df, ["l_returnflag", "l_linestatus"], "u", "v"))


@register(
    "transport",
    f"""SELECT year, {R('coalesce(sum(f) FILTER (f > 0), 0)', 'forth')}, {R('coalesce(sum(f) FILTER (f < 0), 0)', 'back')}, {R('sum(f)', 'net')} FROM (
    SELECT year(l_shipdate)::INT AS year, (l_discount - 0.05::DOUBLE) * l_extendedprice / 1e6 AS f FROM lineitem) GROUP BY year""",
)
def transport(spark, d):
    df = _t(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), (F.col("l_discount") - 0.05).alias("v"), "l_extendedprice")
    return _r(profile.transport(df, ["year"], "v", "l_extendedprice"))


_FLOW = "flow AS (SELECT s_nationkey // 5 AS j, s_nationkey % 5 AS i, avg(l_discount - 0.05::DOUBLE) AS u, avg(l_tax - 0.04::DOUBLE) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
_FULL = f"{_FLOW}, lattice AS (SELECT g.j, g.i, u, v FROM (SELECT n // 5 AS j, n % 5 AS i FROM range(25) r(n)) g LEFT JOIN flow USING (j, i))"


def _d(value: str, part: str, along: str, step: float) -> str:
    w = f"(PARTITION BY {part} ORDER BY {along})"
    return f"(CASE WHEN lag({along}) OVER {w} IS NULL THEN lead({value}) OVER {w} - {value} WHEN lead({along}) OVER {w} IS NULL THEN {value} - lag({value}) OVER {w} ELSE (lead({value}) OVER {w} - lag({value}) OVER {w}) / 2 END / {step})"


@register(
    "vorticity",
    f"WITH {_FULL} SELECT j::INT AS j, i::INT AS i, {R(_d('v', 'j', 'i', 0.001) + ' - ' + _d('u', 'i', 'j', 0.002), 'vort')}, {R(_d('u', 'j', 'i', 0.001) + ' + ' + _d('v', 'i', 'j', 0.002), 'div')} FROM lattice",
)
def vorticity(spark, d):
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    flow = rows.groupBy(F.col("s_nationkey").alias("cell")).agg(F.avg(F.col("l_discount") - 0.05).alias("u"), F.avg(F.col("l_tax") - 0.04).alias("v"))
    full = spark.range(25).select(F.col("id").cast("int").alias("cell")).join(flow, "cell", "left").select(*_lattice(F.col("cell"))[:2], "u", "v", F.lit(0).alias("period"))
    return _r(spatial.vorticity_divergence(full, ["period"], "j", "i", "u", "v", 0.001, 0.002).select("j", "i", "vort", "div"))


def _rank_sql(x: str, key: str) -> str:
    return f"(rank() OVER (PARTITION BY {key} ORDER BY {x}) + (count(*) OVER (PARTITION BY {key}, {x}) - 1) / 2.0)"


@register(
    "spearman",
    f"""SELECT *, {R('rho * sqrt(n - 2) / sqrt(greatest(0, 1 - rho * rho))', 't', 3)} FROM (SELECT l_returnflag, count(*)::BIGINT AS n, {R('corr(a, b)', 'rho')} FROM (
    SELECT l_returnflag, {_rank_sql('l_quantity', 'l_returnflag')} AS a, {_rank_sql('l_extendedprice', 'l_returnflag')} AS b FROM lineitem) GROUP BY 1)""",
)
def spearman(spark, d):
    out = stats.spearman(_t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    rho = F.round(F.col("rho") + SHIFT, 4)
    return out.select("l_returnflag", "n", rho.alias("rho"), F.round(rho * F.sqrt(F.col("n") - 2) / F.sqrt(F.greatest(F.lit(0.0), 1 - rho * rho)) + SHIFT, 3).alias("t"))


@register(
    "auc",
    f"""SELECT o_orderpriority, {R('(s - n1 * (n1 + 1) / 2.0) / (n1 * n0)', 'auc')} FROM (SELECT o_orderpriority, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0, sum(r) FILTER (y = 1) AS s FROM (
    SELECT o_orderpriority, (o_orderstatus = 'F')::INT AS y, {_rank_sql('o_totalprice', 'o_orderpriority')} AS r FROM orders) GROUP BY 1)""",
)
def auc(spark, d):
    df = _t(spark, d, "orders").select("o_orderpriority", "o_totalprice", (F.col("o_orderstatus") == "F").alias("y"))
    return _r(stats.auc(df, ["o_orderpriority"], "o_totalprice", "y").select("o_orderpriority", "auc"))


@register("ols", f"SELECT l_returnflag, {R('regr_slope(l_extendedprice, l_quantity)', 'slope', 3)}, {R('regr_intercept(l_extendedprice, l_quantity)', 'intercept', 2)}, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1")
def ols(spark, d):
    out = stats.ols(_t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", F.round(F.col("slope") + SHIFT, 3).alias("slope"), F.round(F.col("intercept") + SHIFT, 2).alias("intercept"), "n")


@register(
    "selectivity",
    f"""SELECT l_returnflag, n, {R('u', 'use')}, {R('a', 'avail')}, {R('(u - a) / sd', 'si')} FROM (SELECT l_returnflag, count(*)::BIGINT AS n, sum(l_discount * l_quantity) / sum(l_quantity) AS u, avg(l_discount) AS a, stddev_pop(l_discount) AS sd
    FROM lineitem GROUP BY 1 HAVING count(*) >= 10 AND sum(l_quantity) > 0)""",
)
def selectivity(spark, d):
    return _r(stats.selectivity(_t(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity"))


@register(
    "use_availability",
    f"""WITH b AS (SELECT l_returnflag, floor((l_extendedprice - 900) / 5000)::INT AS bin, count(*) AS n, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
    s AS (SELECT l_returnflag, bin, n / sum(n) OVER (PARTITION BY l_returnflag) AS a, w / sum(w) OVER (PARTITION BY l_returnflag) AS u FROM b)
    SELECT l_returnflag, bin, {R('a', 'avail')}, {R('u', 'use')}, {R('u / a', 'q')} FROM s""",
)
def use_availability(spark, d):
    return _r(stats.use_availability(_t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", 900.0, 5000.0))


@register(
    "order_statistics",
    """SELECT l_returnflag, n, x[least(floor(n * 0.05)::BIGINT, n - 1) + 1] AS p5, x[least(floor(n * 0.5)::BIGINT, n - 1) + 1] AS p50, x[least(floor(n * 0.95)::BIGINT, n - 1) + 1] AS p95
    FROM (SELECT l_returnflag, count(*)::BIGINT AS n, list(l_extendedprice ORDER BY l_extendedprice) AS x FROM lineitem GROUP BY 1)""",
)
def order_statistics(spark, d):
    return stats.order_statistics(_t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p5": 0.05, "p50": 0.5, "p95": 0.95})


@register(
    "robust_mean",
    f"""WITH m AS (SELECT p_brand, median(p_retailprice) AS mid, count(*) AS n FROM part GROUP BY 1)
    SELECT p_brand, max(n)::BIGINT AS n, (count(*) FILTER (abs(p_retailprice - mid) < 200))::BIGINT AS k,
      CASE WHEN count(*) FILTER (abs(p_retailprice - mid) < 200) >= greatest(3, max(n) * 0.3) THEN {R('avg(p_retailprice) FILTER (abs(p_retailprice - mid) < 200)', 'x').removesuffix(' AS x')} END AS mean
    FROM part JOIN m USING (p_brand) GROUP BY 1""",
)
def robust_mean(spark, d):
    return _r(stats.robust_mean(_t(spark, d, "part"), ["p_brand"], "p_retailprice", 200.0))


_KM = "sqrt(((a.lon - b.lon) * cos(radians(25.0))) ** 2 + (a.lat - b.lat) ** 2) * 111.2"
_NODES = f"nodes AS (SELECT segment, {LATTICE}, x FROM (SELECT c_mktsegment AS segment, c_nationkey AS c, avg(c_acctbal) AS x FROM customer GROUP BY 1, 2))"


def _nodes(spark, d):
    df = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("cell")).agg(F.avg("c_acctbal").alias("x"))
    return df.select("segment", *_lattice(F.col("cell")), "x")


@register("nearest_distance", f"WITH {_NODES} SELECT a.segment, a.j::INT AS j, a.i::INT AS i, {R(f'min({_KM})', 'km', 3)} FROM nodes a LEFT JOIN (SELECT * FROM nodes WHERE x >= 5000) b ON a.segment = b.segment GROUP BY 1, 2, 3")
def nearest_distance(spark, d):
    n = _nodes(spark, d)
    return _r(spatial.nearest_distance(n, n.where("x >= 5000"), ["segment"]).select("segment", "j", "i", "km"), 3)


@register(
    "moran_bands",
    f"""WITH {_NODES}, z AS (SELECT segment, lon, lat, x - avg(x) OVER (PARTITION BY segment) AS z FROM nodes), s AS (SELECT segment, avg(z * z) AS var FROM z GROUP BY 1),
    p AS (SELECT a.segment, a.z * b.z AS zz, {_KM} AS d FROM z a JOIN z b ON a.segment = b.segment)
    SELECT segment, CASE WHEN d <= 310 THEN 0 WHEN d <= 500 THEN 1 ELSE 2 END AS band, count(*)::BIGINT AS pairs, {R('sum(zz) / count(*) / max(var)', 'i')} FROM p JOIN s USING (segment) WHERE d > 0 AND d <= 800 GROUP BY 1, 2""",
)
def moran_bands(spark, d):
    return _r(spatial.moran_bands(_nodes(spark, d), ["segment"], "x", [0.0, 310.0, 500.0, 800.0]))


@register(
    "water_mass_shares",
    f"""WITH c AS (SELECT l_returnflag, l_quantity AS w, CASE WHEN l_discount IS NULL OR l_tax IS NULL THEN NULL WHEN s < 34 THEN 'coastal' WHEN s >= 34.6 AND t < 22 THEN 'subsurface' WHEN s >= 34.6 THEN 'surface' ELSE 'shelf' END AS mass
      FROM (SELECT *, 15 + l_discount * 100 AS t, 33.5 + l_tax * 20 AS s FROM lineitem))
    SELECT l_returnflag, mass, {R('sum(w) / sum(sum(w)) OVER (PARTITION BY l_returnflag)', 'use')}, {R('count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag)', 'avail')} FROM c GROUP BY 1, 2""",
)
def water_mass_shares(spark, d):
    mass = scalars.water_mass(15 + F.col("l_discount") * 100, 33.5 + F.col("l_tax") * 20)
    sums = _t(spark, d, "lineitem").groupBy("l_returnflag", mass.alias("mass")).agg(F.sum("l_quantity").alias("w"), F.count("*").alias("n"))
    from pyspark.sql.window import Window

    whole = Window.partitionBy("l_returnflag")
    return _r(sums.select("l_returnflag", "mass", (F.col("w") / F.sum("w").over(whole)).alias("use"), (F.col("n") / F.sum("n").over(whole)).alias("avail")))
