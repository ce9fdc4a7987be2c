"""Reports over an atlas of order lines: suppliers and parts deal them to 42 nodes, line numbers to four periods, quantities
to levels. Temperature and density fall and rise with the level and with mean discount and tax, the flow is made of both; some
stations have no profile. All are made of sums of whole numbers, so that no order of adding changes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..operators import fishery, hydro, planes, profile, stats
from .climate import R, _r, _t
from .registry import register

_T = "(2800 - l * 95 + (sd * 60) div n - CASE WHEN l > 3 + i % 4 THEN 250 ELSE 0 END)"
_SG = "(2200 + l * 12 + (st * 9) div n + CASE WHEN l > 3 + i % 4 THEN 60 ELSE 0 END)"
_U, _VV = "((sd * 60) div n - 300)", "((st * 75) div n - 300)"
_NO_PROFILE, _NO_FLOW = "(j + i * 2 + period) % 11 = 0 OR (j * 3 + i * 5 + l * 2 + period) % 23 = 0", "(j * 3 + i * 5 + l + period) % 37 = 0"
_EFFORT = "cast(whole % 50 AS int)"
NODE, PERIODS = ["j", "i", "period"], [13, 14, 15, 16]


def _columns(double: str) -> list[str]:
    n = lambda x, gone, a: f"CASE WHEN {gone} THEN NULL ELSE {x} / {double} END AS {a}"
    ten = double.replace("100", "10")
    return ["j", "i", "period", f"18.0 + j / {double} * 25 AS lat", f"121.0 + i / {double} * 25 AS lon", f"l * 100 / {ten} AS p", n(_T, _NO_PROFILE, "t"), n(_SG, _NO_PROFILE, "sg"), n(_U, _NO_FLOW, "u"), n(_VV, _NO_FLOW, "v"), f"{_EFFORT} AS eff"]


def atlas(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").selectExpr(*_LINES, "cast(round(l_discount * 100) AS long) AS sd", "cast(round(l_tax * 100) AS long) AS st")
    levels = lines.groupBy(*NODE, "l").agg(F.count("*").alias("n"), F.sum("sd").alias("sd"), F.sum("st").alias("st"))
    return levels.withColumn("whole", F.sum("n").over(Window.partitionBy(*NODE))).selectExpr(*_columns("100.0D"))  # at most 13 levels to a node


_LINES = ["cast(l_suppkey % 6 AS int) AS j", "cast(l_partkey % 7 AS int) AS i", "cast(13 + l_linenumber % 4 AS int) AS period", "cast(floor(l_quantity / 4) AS int) AS l"]
_ATLAS = f"""atlas AS MATERIALIZED (SELECT {', '.join(_columns('100.0::DOUBLE')).replace(' div ', ' // ')} FROM (SELECT *, sum(n) OVER (PARTITION BY j, i, period)::BIGINT AS whole FROM (
    SELECT j, i, period, l, count(*) AS n, sum(sd)::BIGINT AS sd, sum(st)::BIGINT AS st FROM (SELECT {', '.join(_LINES)}, round(l_discount * 100)::BIGINT AS sd, round(l_tax * 100)::BIGINT AS st FROM lineitem) GROUP BY ALL)))"""


def _tail(t: str, v: str) -> str:
    """SQL of Student's two-sided tail, by Simpson's rule over the angle."""
    a = f"atan(({t}) / sqrt({v}))"
    return f"(1 - 2 * exp(lgamma((({v}) + 1) / 2) - lgamma(({v}) / 2)) / sqrt(pi()) * {a} / 3000 * list_sum(list_transform(range(0, 1001), lambda k: (CASE WHEN k = 0 OR k = 1000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos({a} * k / 1000), ({v}) - 1))))"


def _rank(x: str, key: str) -> str:
    return f"(rank() OVER (PARTITION BY {key} ORDER BY {x}) + (count(*) OVER (PARTITION BY {key}, {x}) - 1) / 2.0)"


def _at(x: str, level: float, clamp: bool) -> str:
    """SQL of an interpolated level, over grouped rows."""
    pa, xa, pb, xb = f"max(p) FILTER (p <= {level})", f"arg_max({x}, p) FILTER (p <= {level})", f"min(p) FILTER (p >= {level})", f"arg_min({x}, p) FILTER (p >= {level})"
    inside = f"CASE WHEN {pa} = {pb} THEN {xa} ELSE {xa} + ({xb} - {xa}) * ({level} - {pa}) / ({pb} - {pa}) END"
    return f"coalesce({inside}, {xa}, {xb})" if clamp else inside


_DSIG = f"{_ATLAS}, dsig AS (SELECT j, i, period, any_value(lat) AS lat, any_value(lon) AS lon, {_at('sg', 100, True)} - {_at('sg', 0, True)} AS dsig FROM atlas WHERE sg IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 4 AND min(p) <= 15 AND max(p) >= 100)"


@register("density_difference", f"WITH {_DSIG} SELECT j, i, period, {R('dsig', 'dsig')} FROM dsig")
def density_difference(spark, d):
    return _r(hydro.density_difference(atlas(spark, d), NODE, "p", "sg"))


@register(
    "stability",
    f"""WITH {_ATLAS}, g AS (SELECT j, i, period, p, round((sg - lag(sg) OVER w) / (p - lag(p) OVER w) * 9.81 / 1025, 12) AS n2, (p + lag(p) OVER w) / 2 AS mid FROM atlas WHERE sg IS NOT NULL WINDOW w AS (PARTITION BY j, i, period ORDER BY p))
    SELECT j, i, period, {R('max(n2) * 1e4', 'n2max')}, {R('arg_max(mid, (n2, -p)) FILTER (n2 IS NOT NULL)', 'zn2')} FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
)
def stability(spark, d):
    return _r(hydro.stability(atlas(spark, d), NODE, "p", "sg").withColumn("n2max", F.col("n2max") * 1e4))


_MLD = f"""mld AS (SELECT j, i, period, coalesce(min(p) FILTER (p > 10 AND t < ref - 0.5), max(p)) AS mld, count(*) FILTER (p > 10 AND t < ref - 0.5) = 0 AS bottom FROM atlas
    JOIN (SELECT j, i, period, {_at('t', 10, False)} AS ref FROM atlas WHERE t IS NOT NULL GROUP BY 1, 2, 3) USING (j, i, period) WHERE t IS NOT NULL GROUP BY 1, 2, 3)"""


@register("mixed_layer", f"WITH {_ATLAS}, {_MLD} SELECT j, i, period, {R('mld', 'mld')}, bottom FROM mld")
def mixed_layer(spark, d):
    return _r(hydro.mixed_layer(atlas(spark, d), NODE, "p", "t"))


@register("nearest_level", f"WITH {_ATLAS} SELECT j, i, period, p, t, sg FROM (SELECT *, row_number() OVER (PARTITION BY j, i, period ORDER BY abs(p - 35), p) AS r FROM atlas WHERE t IS NOT NULL) WHERE r = 1")
def nearest_level(spark, d):
    return hydro.nearest_level(atlas(spark, d).where("t IS NOT NULL"), NODE, "p", 35.0).select(*NODE, "p", "t", "sg")


@register("layer_bounds", f"WITH {_ATLAS} SELECT j, i, period, p, coalesce((p + lag(p) OVER w) / 2, 0) AS top, coalesce((p + lead(p) OVER w) / 2, p) AS base FROM atlas WHERE t IS NOT NULL WINDOW w AS (PARTITION BY j, i, period ORDER BY p)")
def layer_bounds(spark, d):
    return hydro.layer_bounds(atlas(spark, d).where("t IS NOT NULL"), NODE, "p").select(*NODE, "p", "top", "base")


_REGION = "CASE WHEN lon < 121.7 THEN 'west' ELSE 'east' END AS region"


@register(
    "region_profiles",
    f"WITH {_DSIG}, {_MLD} SELECT {_REGION}, period, count(*)::BIGINT AS ncell, {R('sum(dsig * cos(radians(lat))) / sum(cos(radians(lat))) FILTER (dsig IS NOT NULL)', 'dsig')}, {R('sum(mld * cos(radians(lat))) / sum(cos(radians(lat))) FILTER (mld IS NOT NULL)', 'mld')} FROM (SELECT DISTINCT j, i, period, lat, lon FROM atlas) LEFT JOIN (SELECT j, i, period, dsig FROM dsig) USING (j, i, period) LEFT JOIN mld USING (j, i, period) GROUP BY 1, 2",
)
def region_profiles(spark, d):
    a = atlas(spark, d)
    nodes = a.select(*NODE, "lat", "lon").distinct().selectExpr("*", _REGION).withColumn("w", scalars.area_weight(F.col("lat")))
    metrics = nodes.join(hydro.density_difference(a, NODE, "p", "sg"), NODE, "left").join(hydro.mixed_layer(a, NODE, "p", "t"), NODE, "left")
    return _r(hydro.region_stats(metrics, ["region", "period"], ["dsig", "mld"], "w"))


@register(
    "seasonal_flow",
    f"""WITH {_ATLAS}, f AS (SELECT j, i, p FROM atlas WHERE u IS NOT NULL AND period IN (13, 14, 15, 16) GROUP BY 1, 2, 3 HAVING count(DISTINCT period) = 4)
    SELECT region, period, {R('u', 'u')}, {R('v', 'v')}, {R('speed', 'speed')}, {R('sqrt(u * u + v * v)', 'vec')}, {R('sqrt(u * u + v * v) / speed', 'stab')} FROM (SELECT {_REGION}, period, avg(u) AS u, avg(v) AS v, avg(sqrt(u * u + v * v)) AS speed FROM atlas SEMI JOIN f USING (j, i, p) WHERE p <= 100 AND u IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2)""",
)
def seasonal_flow(spark, d):
    common = hydro.common_cells(atlas(spark, d).where("p <= 100"), ["j", "i", "p"], "period", "u", PERIODS)
    return _r(profile.flow_stability(common.selectExpr("*", _REGION), ["region", "period"], "u", "v"))


@register("zero_crossings", f"WITH {_ATLAS} SELECT j, period, {R('x0 + (lon - x0) * v0 / (v0 - v)', 'at')} FROM (SELECT *, lag(lon) OVER w AS x0, lag(v) OVER w AS v0 FROM atlas WHERE p = 0 AND v IS NOT NULL WINDOW w AS (PARTITION BY j, period ORDER BY lon)) WHERE (v > 0) <> (v0 > 0)")
def zero_crossings(spark, d):
    return _r(hydro.zero_crossings(atlas(spark, d).where("p = 0"), ["j", "period"], "lon", "v"))


_SPEED = "round(sqrt(u * u + v * v), 6)"


@register("strongest_axis", f"WITH {_ATLAS} SELECT * FROM (SELECT j, period, arg_max(lon, (spd, -lon)) AS lon, max(spd) AS spd FROM (SELECT *, {_SPEED} AS spd FROM atlas WHERE p = 0 AND lon >= 121.5) WHERE spd IS NOT NULL GROUP BY 1, 2) WHERE spd >= 0.5")
def strongest_axis(spark, d):
    return hydro.strongest_axis(atlas(spark, d).where("p = 0 AND lon >= 121.5").selectExpr("*", f"{_SPEED} AS spd"), ["j", "period"], "lon", "spd")


@register("observed_span", f"WITH {_ATLAS} SELECT j, i, period, t FROM atlas JOIN (SELECT j, period, min(i) - 1 AS a, max(i) + 1 AS z FROM atlas WHERE p = 20 AND t IS NOT NULL GROUP BY 1, 2) USING (j, period) WHERE p = 20 AND i BETWEEN a AND z")
def observed_span(spark, d):
    return hydro.observed_span(atlas(spark, d).where("p = 20"), ["j", "period"], "i", "t").select("j", "i", "period", "t")


_X = lambda p, q, x, y: f"CASE WHEN ({p} >= 28.1) <> ({q} >= 28.1) THEN {{'x': ({x})::DOUBLE, 'y': ({y})::DOUBLE}} END"
_F = lambda p, q: f"(28.1 - {p}) / ({q} - {p})"


@register(
    "contours",
    f"""WITH {_ATLAS}, g AS (SELECT j, i, period, t FROM atlas WHERE p = 30 AND t IS NOT NULL),
    q AS (SELECT a.period, a.j, a.i, a.t AS a, b.t AS b, c.t AS c, d.t AS d FROM g a JOIN g b ON b.period = a.period AND b.j = a.j AND b.i = a.i + 1 JOIN g c ON c.period = a.period AND c.j = a.j + 1 AND c.i = a.i + 1 JOIN g d ON d.period = a.period AND d.j = a.j + 1 AND d.i = a.i),
    e AS (SELECT period, j, i, list_filter([{_X('a', 'b', 'i + ' + _F('a', 'b'), 'j')}, {_X('b', 'c', 'i + 1', 'j + ' + _F('b', 'c'))}, {_X('d', 'c', 'i + ' + _F('d', 'c'), 'j + 1')}, {_X('a', 'd', 'i', 'j + ' + _F('a', 'd'))}], lambda z: z IS NOT NULL) AS e FROM q),
    s AS (SELECT period, j, i, unnest(CASE WHEN len(e) = 4 THEN [[e[1], e[2]], [e[3], e[4]]] ELSE [[e[1], e[2]]] END) AS s FROM e WHERE len(e) >= 2)
    SELECT period, j, i, {R('s[1].x', 'x0')}, {R('s[1].y', 'y0')}, {R('s[2].x', 'x1')}, {R('s[2].y', 'y1')} FROM s""",
)
def contours(spark, d):
    return _r(hydro.contour_segments(atlas(spark, d).where("p = 30 AND t IS NOT NULL"), ["period"], "j", "i", "t", 28.1))


@register(
    "spearman_p",
    f"""WITH r AS (SELECT p_type, count(*)::BIGINT AS n, corr(a, b) AS rho FROM (SELECT p_type, {_rank('p_size', 'p_type')} AS a, {_rank('p_retailprice', 'p_type')} AS b FROM part) GROUP BY 1 HAVING count(*) >= 5)
    SELECT p_type, n, {R('rho', 'rho')}, {R(_tail('abs(rho) * sqrt((n - 2) / greatest(1e-12, 1 - rho * rho))', '(n - 2)'), 'p')} FROM r""",
)
def spearman_p(spark, d):
    out = stats.spearman(_t(spark, d, "part"), ["p_type"], "p_size", "p_retailprice").where("n >= 5")
    t = F.abs("rho") * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-12), 1 - F.col("rho") * F.col("rho")))
    return _r(out.select("p_type", "n", "rho", scalars.student_two_sided(t, (F.col("n") - 2).cast("double")).alias("p")))


EDGES = [0.0, 30.0, 60.0, 90.0, 120.0, 160.0, 220.0, 300.0]
_NODES = "nodes AS (SELECT j, i, period, lat, lon, t, eff FROM atlas WHERE p = 50 AND t IS NOT NULL)"
_KM = "sqrt(((a.lon - b.lon) * cos(radians(25.0))) ** 2 + (a.lat - b.lat) ** 2) * 111.2"


@register(
    "corrected_correlation",
    f"""WITH {_ATLAS}, {_NODES}, r AS (SELECT *, {_rank('t', 'period')} AS a, {_rank('ln(1 + eff)', 'period')} AS b FROM nodes),
    z AS (SELECT period, lon, lat, a - avg(a) OVER (PARTITION BY period) AS x, b - avg(b) OVER (PARTITION BY period) AS y FROM r), s AS (SELECT period, count(*) AS n, avg(x * x) AS vx, avg(y * y) AS vy, corr(x, y) AS rho FROM z GROUP BY 1),
    d AS (SELECT a.period, a.x * b.x AS xx, a.y * b.y AS yy, {_KM} AS d FROM z a JOIN z b ON a.period = b.period),
    m AS (SELECT period, band, count(*) AS pairs, sum(xx) / count(*) AS mx, sum(yy) / count(*) AS my FROM (SELECT *, CASE {' '.join(f'WHEN d > {a} AND d <= {b} THEN {k}' for k, (a, b) in enumerate(zip(EDGES, EDGES[1:])))} END AS band FROM d) WHERE band IS NOT NULL GROUP BY 1, 2),
    v AS (SELECT period, n, rho, sum(pairs * mx / vx * my / vy) / (n * n) + 1.0 / n AS var FROM m JOIN s USING (period) GROUP BY period, n, rho),
    e AS (SELECT *, least(n, greatest(3, CASE WHEN var > 0 THEN 1 + 1 / var ELSE n END))::DOUBLE AS ne FROM v)
    SELECT period, n::BIGINT AS n, {R('rho', 'rho')}, {R('ne', 'ne')}, {R(_tail('abs(rho) * sqrt((ne - 2) / (1 - rho * rho))', '(ne - 2)'), 'p')} FROM e""",
)
def corrected_correlation(spark, d):
    nodes = atlas(spark, d).where("p = 50 AND t IS NOT NULL").withColumn("e", F.log1p("eff"))
    return _r(fishery.corrected_correlation(nodes, ["period"], "t", "e", EDGES))


_SHIFT = f"""{_ATLAS}, at50 AS (SELECT j, i, period, t, eff FROM atlas WHERE p = 50),
    two AS (SELECT j, i, a.t AS va, b.t AS vb, a.eff AS wa, b.eff AS wb FROM (SELECT * FROM at50 WHERE period = 13) a JOIN (SELECT * FROM at50 WHERE period = 15) b USING (j, i)),
    shift AS (SELECT j, i, vb - va AS dv, wb / (SELECT nullif(sum(wb), 0) FROM two) * 100 - wa / (SELECT nullif(sum(wa), 0) FROM two) * 100 AS dw, wa + wb AS w FROM two WHERE wa > 0 OR wb > 0)"""


def _shift(spark, d):
    return fishery.period_shift(atlas(spark, d).where("p = 50"), ["j", "i"], "period", 13, 15, "t", "eff")


@register("period_shift", f"WITH {_SHIFT} SELECT j, i, {R('dv', 'dv')}, {R('dw', 'dw')} FROM shift")
def period_shift(spark, d):
    return _r(_shift(spark, d).select("j", "i", "dv", "dw"))


@register(
    "period_shift_test",
    f"""WITH {_SHIFT}, k AS (SELECT * FROM shift WHERE dv IS NOT NULL AND dw IS NOT NULL), r AS (SELECT *, {_rank('dv', '1')} AS a, {_rank('round(dw, 9)', '1')} AS b FROM k),
    s AS (SELECT count(*)::BIGINT AS n, corr(a, b) AS rho, sum(dv * w) / sum(w) AS dmean FROM r) SELECT n, {R('rho', 'rho')}, {R(_tail('abs(rho) * sqrt((n - 2) / greatest(1e-12, 1 - rho * rho))', '(n - 2)'), 'p')}, {R('dmean', 'dmean')} FROM s WHERE n >= 12""",
)
def period_shift_test(spark, d):
    rows = _shift(spark, d).select(F.lit(0).alias("all"), "dv", F.round("dw", 9).alias("dw"), "w")
    return _r(fishery.shift_correlation(rows, ["all"]).drop("all"))


@register(
    "outline",
    f"WITH {_ATLAS}, s AS (SELECT DISTINCT j, i FROM atlas WHERE period = 13 AND eff > 25) SELECT s.j, s.i, side FROM s, (VALUES ('below', -1, 0), ('above', 1, 0), ('left', 0, -1), ('right', 0, 1)) d(side, dj, di) WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.j = s.j + dj AND o.i = s.i + di)",
)
def outline(spark, d):
    return fishery.outline(atlas(spark, d).where("period = 13 AND eff > 25").select("j", "i").distinct())


def _around_sql(src: str, out: str) -> str:
    return f"""{out} AS (SELECT a.period, a.j, a.i, any_value(a.t) AS t, median(b.t) AS mid FROM (SELECT *, unnest(range(-2, 3)) AS di FROM (SELECT *, unnest(range(-2, 3)) AS dj FROM {src} JOIN (
      SELECT period, min(j) AS j0, max(j) AS j1, min(i) AS i0, max(i) AS i1 FROM {src} GROUP BY 1) USING (period))) a
    LEFT JOIN {src} b ON b.period = a.period AND b.j = greatest(least(a.j + dj, j1), j0) AND b.i = greatest(least(a.i + di, i1), i0) GROUP BY 1, 2, 3)"""


_DROP = "(SELECT period, j, i, CASE WHEN t - mid > 0.6 THEN NULL ELSE t END AS t FROM {})"


@register(
    "cleaned",
    f"WITH {_ATLAS}, c0 AS (SELECT period, j, i, t FROM atlas WHERE p = 30), {_around_sql('c0', 'm0')}, c1 AS {_DROP.format('m0')}, {_around_sql('c1', 'm1')}, c2 AS {_DROP.format('m1')}, {_around_sql('c2', 'm2')}"
    " SELECT period, j, i, CASE WHEN c0.t IS NOT NULL THEN coalesce(m2.t, mid) END AS t FROM m2 JOIN c0 USING (period, j, i)",
)
def cleaned(spark, d):
    return fishery.cleaned(atlas(spark, d).where("p = 30").select("period", "j", "i", "t"), ["period"], "t").select("period", "j", "i", "t")


@register("flow_arrows", f"WITH {_ATLAS} SELECT j, i, period, u, v FROM atlas WHERE p = 0 AND i % 2 = 0 AND j % 2 = 0 AND sqrt(u * u + v * v) >= 0.02")
def flow_arrows(spark, d):
    return atlas(spark, d).where("p = 0 AND i % 2 = 0 AND j % 2 = 0 AND sqrt(u * u + v * v) >= 0.02").select("j", "i", "period", "u", "v")


@register("profile_arrays", f"WITH {_ATLAS} SELECT j, i, period, string_agg(printf('%.0f:%.2f', p, t), ',' ORDER BY p) AS profile FROM atlas WHERE t IS NOT NULL GROUP BY 1, 2, 3")
def profile_arrays(spark, d):
    own = F.array_sort(F.collect_list(F.struct("p", "t")))
    return atlas(spark, d).where("t IS NOT NULL").groupBy(*NODE).agg(F.array_join(F.transform(own, lambda s: F.format_string("%.0f:%.2f", s["p"], s["t"])), ",").alias("profile"))


@register("water_points", f"WITH {_ATLAS} SELECT j, i, period, t, sg, eff FROM atlas WHERE t IS NOT NULL AND sg IS NOT NULL AND p <= 60 AND eff > 1")
def water_points(spark, d):
    return atlas(spark, d).where("t IS NOT NULL AND sg IS NOT NULL AND p <= 60 AND eff > 1").select("j", "i", "period", "t", "sg", "eff")


@register("exported_planes", f"WITH {_ATLAS}, h AS (SELECT period, j, i, printf('%04x', coalesce(round(t * 100), -32768)::INT & 65535) AS w FROM atlas WHERE p = 0) SELECT period, base64(unhex(string_agg(w[3:4] || w[1:2], '' ORDER BY j, i))) AS plane FROM h GROUP BY 1")
def exported_planes(spark, d):
    return planes.to_plane(atlas(spark, d).where("p = 0"), ["period"], ["j", "i"], scalars.quantised(F.col("t")))


_FINE = "(SELECT (o_custkey % 30)::INT AS jx, (o_orderkey % 35)::INT AS ix, sum(round(o_totalprice)::BIGINT)::DOUBLE / count(*) / 1000 AS sst, count(*)::INT AS hours, (count(*) FILTER (o_orderpriority = '1-URGENT'))::INT AS foot FROM orders GROUP BY 1, 2)"


def _fine(spark, d):
    """Orders on a finer lattice of 30 x 35."""
    at = [(F.col("o_custkey") % 30).cast("int").alias("jx"), (F.col("o_orderkey") % 35).cast("int").alias("ix")]
    sst = (F.sum(F.round("o_totalprice").cast("long")) / F.count("*") / 1000).alias("sst")
    return _t(spark, d, "orders").groupBy(*at).agg(sst, F.count("*").cast("int").alias("hours"), F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("int").alias("foot"))


@register(
    "fishery_nodes",
    f"""WITH {_ATLAS}, ctd AS (SELECT j, i, period, {_at('t', 45, False)} AS t45 FROM atlas WHERE t IS NOT NULL GROUP BY 1, 2, 3), {_MLD},
    deep AS (SELECT j, i, max(p) AS dmax FROM (SELECT j, i, p FROM atlas WHERE t IS NOT NULL UNION ALL SELECT j, i, p FROM atlas WHERE u IS NOT NULL) GROUP BY 1, 2),
    box AS (SELECT j, i, avg(sst) AS sst, sum(hours)::BIGINT AS hours, avg((foot > 0)::INT) AS foot FROM (SELECT j, i FROM range(6) a(j), range(7) b(i)) n JOIN {_FINE} f ON jx BETWEEN j * 5 - 2 AND j * 5 + 2 AND ix BETWEEN i * 5 - 2 AND i * 5 + 2 GROUP BY 1, 2)
    SELECT g.j::INT AS j, g.i::INT AS i, g.period::INT AS period, {R('t45', 't45')}, {R('mld', 'mld')}, dmax, {R('sst', 'sst')}, hours, {R('foot', 'foot')}, {R('ln(1 + hours)', 'effort')}, (18 + g.j // 4) || '_' || (121 + g.i // 4) AS block
    FROM (SELECT j, i, period FROM range(6) a(j), range(7) b(i), (VALUES (13), (14), (15), (16)) c(period)) g LEFT JOIN ctd USING (j, i, period) LEFT JOIN mld USING (j, i, period) LEFT JOIN deep USING (j, i) LEFT JOIN box USING (j, i)""",
)
def fishery_nodes(spark, d):
    a = atlas(spark, d)
    grid = fishery.skeleton(spark, 6, 7, PERIODS)
    t45 = hydro.at_level(a, NODE, "p", "t", 45.0, clamp=False).withColumnRenamed("t", "t45")
    deep = fishery.deepest([a.where("t IS NOT NULL"), a.where("u IS NOT NULL")], ["j", "i"], "p")
    fine = _fine(spark, d)
    box = fishery.box_aggregate(fishery.boxes_of(fine, grid.select("j", "i").distinct()), ["j", "i"], "sst", "hours", "foot")
    out = fishery.assembled(grid, [t45, hydro.mixed_layer(a, NODE, "p", "t").drop("bottom"), deep, box], NODE)
    block = fishery.block_id(18.0 + 0.25 * F.col("j"), 121.0 + 0.25 * F.col("i"))
    return _r(out.select(*NODE, "t45", "mld", F.col("dmax"), "sst", "hours", "foot", F.log1p("hours").alias("effort"), block.alias("block")))


_BRIDGE = [(p, m) for p, ms in ((13, (12, 1, 2)), (17, (10, 11, 12, 1, 2, 3))) for m in ms]


@register(
    "period_effort",
    f"""WITH m AS (SELECT (o_custkey % 10)::INT AS cell, strftime(o_orderdate, '%Y-%m') AS ym, count(*) AS hours FROM orders GROUP BY 1, 2),
    bridge(period, month) AS (VALUES {', '.join(map(str, _BRIDGE))}), n AS (SELECT period, count(DISTINCT ym) AS n FROM m JOIN bridge ON month = substr(ym, 6, 2)::INT GROUP BY 1)
    SELECT cell, period::INT AS period, {R('sum(hours) / any_value(n)', 'hours')} FROM m JOIN bridge ON month = substr(ym, 6, 2)::INT JOIN n USING (period) GROUP BY 1, 2""",
)
def period_effort(spark, d):
    m = _t(spark, d, "orders").groupBy((F.col("o_custkey") % 10).cast("int").alias("cell"), F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(F.count("*").alias("hours"))
    return _r(fishery.period_effort(m, spark.createDataFrame(_BRIDGE, "period int, month int"), ["cell"], "ym", "hours"))


@register("first_of_day", "SELECT user_id, day, event_id, value FROM (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_of_day(spark, d):
    return planes.first_of(_t(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], ["ts", "event_id"]).select("user_id", "day", "event_id", "value")


@register("fetch_windows", "SELECT a::DATE AS a, least(a::DATE + 29, z) AS b FROM (SELECT unnest(generate_series(f, z, INTERVAL 30 DAY)) AS a, z FROM (SELECT min(o_orderdate)::DATE AS f, max(o_orderdate)::DATE AS z FROM orders))")
def fetch_windows(spark, d):
    span = _t(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("f"), F.to_date(F.max("o_orderdate")).alias("z"))
    return planes.windows(span, "f", "z", 30)
