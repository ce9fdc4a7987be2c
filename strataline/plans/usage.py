"""Reports of activity: order lines by month and return flag, effort over the atlas, and regions' trends with their error."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events, spatial, usage
from . import atlas, ocean
from .climate import R, _r, _t
from .registry import register

_USE = """u AS (SELECT strftime(l_shipdate, '%Y-%m') AS ym, sum(x * w) / sum(w) AS use, avg(x) AS avail, sum(w) / count(DISTINCT l_suppkey) AS per_unit
    FROM (SELECT l_shipdate, l_suppkey, round(l_extendedprice * 100)::BIGINT / 100000 AS x, l_quantity::DOUBLE AS w FROM lineitem) GROUP BY 1)"""


def _use(spark, d):
    lines = _t(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("ym"), "l_suppkey", (F.round(F.col("l_extendedprice") * 100).cast("long") / 100000).alias("x"), F.col("l_quantity").cast("double").alias("w"))
    return usage.use_series(lines, ["ym"], "x", "w", "l_suppkey")


@register("use_series", f"WITH {_USE} SELECT ym, {R('use', 'use')}, {R('avail', 'avail')}, {R('per_unit', 'per_unit')} FROM u")
def use_series(spark, d):
    return _r(_use(spark, d))


@register(
    "tracking",
    f"""WITH {_USE}, s AS (SELECT use, avail, use - avg(use) OVER w AS ys, avail - avg(avail) OVER w AS xs FROM u WINDOW w AS (PARTITION BY substr(ym, 6, 2)))
    SELECT count(*)::BIGINT AS n, {R('regr_slope(use, avail)', 'slope')}, {R('corr(use, avail)', 'r')}, {R('regr_slope(ys, xs)', 'season_slope')} FROM s""",
)
def tracking(spark, d):
    s = _use(spark, d).select("use", "avail", F.substring("ym", 6, 2).alias("season"), F.lit(0).alias("all"))
    return _r(usage.tracking(s, ["all"], "season").drop("all"))


@register(
    "autocorrelated_trends",
    f"""WITH {ocean._REGION}, f AS (SELECT region, regr_slope(mean, year) AS b, regr_intercept(mean, year) AS a, regr_sxx(mean, year) AS sxx FROM annual GROUP BY 1),
    e AS (SELECT *, mean - a - b * year AS e FROM annual JOIN f USING (region)), g AS (SELECT *, CASE WHEN year - lag(year) OVER w = 1 THEN e * lag(e) OVER w END AS ee FROM e WINDOW w AS (PARTITION BY region ORDER BY year)),
    s AS (SELECT region, count(*)::BIGINT AS n, any_value(b) AS b, any_value(sxx) AS sxx, sum(e * e) AS sse, sum(ee) / sum(e * e) AS r1 FROM g GROUP BY 1 HAVING count(*) >= 5),
    v AS (SELECT *, least(n, greatest(3, n * (1 - r1) / (1 + r1)))::DOUBLE AS ne FROM s), z AS (SELECT *, sqrt(sse / (ne - 2) / sxx) AS se FROM v)
    SELECT region, n, {R('b * 10', 'slope')}, {R('19.6 * se', 'ci95')}, {R('r1', 'r1')}, {R('ne', 'ne')}, {R(atlas._tail('abs(b) / se', '(ne - 2)'), 'p')} FROM z""",
)
def autocorrelated_trends(spark, d):
    return _r(usage.autocorrelated_trend(ocean._annual(spark, d)[1], ["region"], "year", "mean"))


_Q = lambda p: f"t[least(floor(n * {p}::DOUBLE)::BIGINT, n - 1) + 1]"


@register(
    "group_spread",
    f"""WITH x AS (SELECT l_returnflag, round(l_extendedprice * 100)::BIGINT / 100000 AS x FROM lineitem), m AS (SELECT {_Q(0.5)} AS mid FROM (SELECT list(x ORDER BY x) AS t, count(*) AS n FROM x)),
    g AS (SELECT l_returnflag, list(x ORDER BY x) AS t, count(*)::BIGINT AS n FROM x GROUP BY 1) SELECT l_returnflag, n, {R(_Q(0.25), 'p25')}, {R(_Q(0.5), 'p50')}, {R(_Q(0.75), 'p75')}, {R(_Q(0.5) + ' - mid', 'apart')} FROM g, m""",
)
def group_spread(spark, d):
    lines = _t(spark, d, "lineitem").select("l_returnflag", (F.round(F.col("l_extendedprice") * 100).cast("long") / 100000).alias("x"))
    return _r(usage.group_spread(lines, "l_returnflag", "x"))


@register(
    "near_share",
    f"""WITH {atlas._ATLAS}, n AS (SELECT * FROM atlas WHERE p = 0 AND u IS NOT NULL), k AS (SELECT a.j, a.i, a.period, any_value(a.eff) AS eff, min({atlas._KM}) AS km FROM n a JOIN n b ON a.period = b.period AND b.u > 0 GROUP BY 1, 2, 3)
    SELECT period, {R('sum(CASE WHEN km <= 10 THEN eff ELSE 0 END) / sum(eff)', 'use')}, {R('avg((km <= 10)::INT)', 'avail')} FROM k GROUP BY 1""",
)
def near_share(spark, d):
    nodes = atlas.atlas(spark, d).where("p = 0 AND u IS NOT NULL")
    return _r(usage.near_share(spatial.nearest_distance(nodes, nodes.where("u > 0"), ["period"]), ["period"], "km", "eff", 10.0))


_PARTS = " UNION ALL ".join(f"SELECT period, lon, lat, eff, '{x}{p}' AS variable, {x} AS x FROM atlas WHERE p = {p} AND {x} IS NOT NULL" for x, p in (("t", 0), ("t", 50), ("v", 0)))


@register(
    "selectivity_map",
    f"""WITH {atlas._ATLAS}, o AS ({_PARTS}), si AS (SELECT period, variable, count(*)::BIGINT AS n, (sum(x * eff) / sum(eff) - avg(x)) / nullif(stddev_pop(x), 0) AS si FROM o GROUP BY 1, 2 HAVING count(*) >= 10 AND sum(eff) > 0),
    r AS (SELECT *, {atlas._rank('x', 'period, variable')} AS a, {atlas._rank('ln(1 + eff)', 'period, variable')} AS b FROM o), z AS (SELECT period, variable, lon, lat, a - avg(a) OVER w AS x, b - avg(b) OVER w AS y FROM r WINDOW w AS (PARTITION BY period, variable)),
    s AS (SELECT period, variable, count(*) AS m, avg(x * x) AS vx, avg(y * y) AS vy, corr(x, y) AS rho FROM z GROUP BY 1, 2 HAVING count(*) >= 12),
    d AS (SELECT a.period, a.variable, a.x * b.x AS xx, a.y * b.y AS yy, {atlas._KM} AS d FROM z a JOIN z b ON a.period = b.period AND a.variable = b.variable),
    b AS (SELECT period, variable, band, count(*) AS pairs, avg(xx) AS mx, avg(yy) AS my FROM (SELECT *, CASE {' '.join(f'WHEN d > {a} AND d <= {b} THEN {k}' for k, (a, b) in enumerate(zip(atlas.EDGES, atlas.EDGES[1:])))} END AS band FROM d) WHERE band IS NOT NULL GROUP BY 1, 2, 3),
    v AS (SELECT period, variable, m, rho, sum(pairs * mx / vx * my / vy) / (m * m) + 1.0 / m AS var FROM b JOIN s USING (period, variable) GROUP BY period, variable, m, rho),
    e AS (SELECT *, least(m, greatest(3, CASE WHEN var > 0 THEN 1 + 1 / var ELSE m END))::DOUBLE AS ne FROM v), p AS (SELECT *, {atlas._tail('abs(rho) * sqrt((ne - 2) / (1 - rho * rho))', '(ne - 2)')} AS p FROM e)
    SELECT period, variable, n, {R('si', 'si')}, {R('rho', 'rho')}, {R('ne', 'ne')}, {R('p', 'p')}, coalesce(p < 0.05, FALSE) AS star, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS stars FROM si LEFT JOIN p USING (period, variable)""",
)
def selectivity_map(spark, d):
    at = lambda x, level: F.max(F.when(F.col("p") == level, F.col(x)))
    nodes = atlas.atlas(spark, d).groupBy(*atlas.NODE).agg(F.max("lon").alias("lon"), F.max("lat").alias("lat"), F.max("eff").alias("eff"), at("t", 0).alias("t0"), at("t", 50).alias("t50"), at("v", 0).alias("v0"))
    return _r(usage.selectivity_map(nodes, ["period"], ["t0", "t50", "v0"], "eff", atlas.EDGES))


@register("event_spans", f"WITH {ocean._EVENTS} SELECT region, daily.day, {R('ano', 'ano')}, start AS event FROM daily LEFT JOIN (SELECT region, start::DATE AS start, unnest(generate_series(start, stop, INTERVAL 1 DAY))::DATE AS day FROM spells) USING (region, day)")
def event_spans(spark, d):
    days, found = ocean._events(spark, d)
    return _r(events.on_days(days.select("region", "day", "ano"), found, ["region"], "day"))


@register(
    "hovmoeller_columns",
    f"""WITH {ocean._MONTHLY}, b AS (SELECT i AS band, ym, any_value(month) AS month, avg(mean) AS x FROM monthly GROUP BY 1, 2), c AS (SELECT i AS band, month, avg(clim) AS y FROM mclim JOIN (SELECT DISTINCT cell, i FROM cube) USING (cell) GROUP BY 1, 2)
    SELECT band::INT AS band, ym, {R('x', 'mean')}, {R('x - y', 'ano')} FROM b LEFT JOIN c USING (band, month)""",
)
def hovmoeller_columns(spark, d):
    m, clim = ocean._monthly(spark, d)
    mean = m.groupBy(F.col("i").alias("band"), "ym").agg(F.avg("mean").alias("mean")).withColumn("month", F.substring("ym", 6, 2).cast("int"))
    own = clim.join(m.select("cell", "i").distinct(), "cell").groupBy(F.col("i").alias("band"), "month").agg(F.avg("clim").alias("clim"))
    return _r(mean.join(own, ["band", "month"], "left").select(F.col("band").cast("int").alias("band"), "ym", "mean", (F.col("mean") - F.col("clim")).alias("ano")))
