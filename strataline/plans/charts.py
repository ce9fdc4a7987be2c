"""Reports that charts are drawn from: sections, flow through them, panels of a node, coast, and colours read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import sections
from ..sources import colour_maps
from . import atlas
from .climate import R, _r, _t
from .registry import register

_SECTIONS = [("south", 2, 0, 6, 90.0), ("north", 4, 1, 5, 60.0)]
_CUT = f"""{atlas._ATLAS}, sec(section, row, a, z, deepest) AS (VALUES {', '.join(map(str, _SECTIONS))}),
    cut AS (SELECT section, j, i, period, lat, p::DOUBLE AS p, t, v FROM atlas JOIN sec ON j = row AND i BETWEEN a AND z AND p <= deepest)"""


def _sections(spark):
    return spark.createDataFrame(_SECTIONS, "section string, j int, first int, last int, deepest double")


def _section_sql(x: str, symmetric: bool) -> str:
    lo, hi = ("-greatest(abs(lo), abs(hi))", "greatest(abs(lo), abs(hi))") if symmetric else ("lo", "hi")
    at = lambda share: f"max({x}) FILTER (k = floor({share}::DOUBLE * (n - 1) + 0.5))"
    return f"""WITH {_CUT}, lay AS (SELECT section, period, p, coalesce((p + lag(p) OVER w) / 2, 0) AS top, coalesce((p + lead(p) OVER w) / 2, p) AS base FROM (SELECT DISTINCT section, period, p FROM cut) WINDOW w AS (PARTITION BY section, period ORDER BY p)),
    o AS (SELECT section, period, {x}, row_number() OVER (PARTITION BY section, period ORDER BY {x}) - 1 AS k, count(*) OVER (PARTITION BY section, period) AS n FROM cut WHERE {x} IS NOT NULL),
    q AS (SELECT section, period, {at(0.02)} AS lo, {at(0.98)} AS hi FROM o GROUP BY 1, 2), r AS (SELECT section, period, {lo} AS lo, {hi} AS hi FROM q),
    s AS (SELECT section, period, min(i) - 1 AS a, max(i) + 1 AS z FROM cut WHERE {x} IS NOT NULL GROUP BY 1, 2)
    SELECT section, period, i, p, {R(x, x)}, {R('top', 'top')}, {R('base', 'base')}, {R('lo', 'lo')}, {R('hi', 'hi')}, {R(f'CASE WHEN {x} IS NOT NULL AND hi > lo THEN greatest(0, least(1, ({x} - lo) / (hi - lo))) END', 'shade')}
    FROM cut JOIN lay USING (section, period, p) JOIN r USING (section, period) JOIN s USING (section, period) WHERE i BETWEEN s.a AND s.z"""


def _section(spark, d, value: str, symmetric: bool):
    levels = atlas.atlas(spark, d).withColumn("p", F.col("p").cast("double"))
    return _r(sections.section_report(levels, _sections(spark), ["period"], "j", "i", "p", value, symmetric))


@register("temperature_section", _section_sql("t", False))
def temperature_section(spark, d):
    return _section(spark, d, "t", False)


@register("flow_section", _section_sql("v", True))
def flow_section(spark, d):
    return _section(spark, d, "v", True)


_AREA = "0.25 * 111320.0 * cos(radians(lat)) * 10.0"


@register(
    "section_transport",
    f"""WITH {_CUT}, f AS (SELECT section, j, i, p FROM cut WHERE v IS NOT NULL AND period IN (13, 14, 15, 16) GROUP BY ALL HAVING count(DISTINCT period) = 4),
    w AS (SELECT section, period, v * ({_AREA})::DOUBLE / 1e6 AS f, x.yes IS NOT NULL AS whole FROM cut LEFT JOIN (SELECT *, TRUE AS yes FROM f) x USING (section, j, i, p) WHERE v IS NOT NULL)
    SELECT section, period, count(*)::BIGINT AS cells, {R('sum(CASE WHEN f > 0 THEN f ELSE 0 END)', 'north')}, {R('sum(CASE WHEN f < 0 THEN f ELSE 0 END)', 'south')}, {R('sum(f)', 'net')},
    {R('sum(CASE WHEN whole THEN f ELSE 0 END)', 'net_common')}, count(*) FILTER (whole)::BIGINT AS common FROM w GROUP BY 1, 2""",
)
def section_transport(spark, d):
    return _r(sections.section_transport(atlas.atlas(spark, d), _sections(spark), "period", "j", "i", "p", "v", F.expr(_AREA), atlas.PERIODS))


@register(
    "profile_panels",
    f"""WITH {atlas._ATLAS} SELECT j, i, period, least(300, ceil(greatest(50, max(p) FILTER (t IS NOT NULL OR u IS NOT NULL OR v IS NOT NULL)) / 50) * 50)::DOUBLE AS depth, floor(min(t))::BIGINT AS t_lo, ceil(max(t))::BIGINT AS t_hi,
    {R('greatest(0.3, coalesce(max(greatest(abs(u), abs(v))), 0))', 'reach')} FROM atlas GROUP BY 1, 2, 3 HAVING count(*) FILTER (t IS NOT NULL OR u IS NOT NULL OR v IS NOT NULL) > 0""",
)
def profile_panels(spark, d):
    return _r(sections.panels(atlas.atlas(spark, d), atlas.NODE, "p", "t", "u", "v"))


@register(
    "coast",
    f"""WITH {atlas._ATLAS}, m AS (SELECT period, p, j, i, t IS NULL AS land FROM atlas)
    SELECT a.period, a.p::DOUBLE AS p, a.j, a.i FROM m a JOIN m b ON b.period = a.period AND b.p = a.p AND abs(a.j - b.j) + abs(a.i - b.i) = 1 WHERE a.land GROUP BY ALL HAVING count(*) = 4 AND NOT bool_and(b.land)""",
)
def coast(spark, d):
    mask = atlas.atlas(spark, d).select("period", F.col("p").cast("double").alias("p"), "j", "i", F.col("t").isNull().alias("land"))
    return sections.coast(mask, ["period", "p"], "j", "i", "land")


#: Colours of equal distances along a bar, and how many steps of it are told apart.
_STOPS = [(20, 40, 250), (20, 220, 230), (60, 220, 40), (250, 210, 30), (230, 30, 20)]
_STEPS = 32


def palette() -> list[tuple[int, int, int]]:
    last = len(_STOPS) - 1
    at = [k * last / _STEPS for k in range(_STEPS + 1)]
    low = [min(int(a), last - 1) for a in at]
    return [tuple(int(p + (q - p) * (a - k) + 0.5) for p, q in zip(_STOPS[k], _STOPS[k + 1])) for a, k in zip(at, low)]


def _channel(c: int, more: str) -> str:
    stops = f"({[float(s[c]) for s in _STOPS]}::DOUBLE[])"
    return f"CASE WHEN dull THEN 120 ELSE floor({stops}[k + 1] + ({stops}[k + 2] - {stops}[k + 1]) * (pos - k) + 0.5)::INT END + {more} AS {'rgb'[c]}"


@register(
    "colours_read",
    f"""WITH x AS (SELECT (l_suppkey % 6)::INT AS j, (l_partkey % 7)::INT AS i, l_returnflag = 'R' AS dull, l_linenumber::INT AS ln, greatest(0, least(1, l_quantity::DOUBLE / 50)) * {len(_STOPS) - 1} AS pos FROM lineitem),
    c AS (SELECT j, i, {_channel(0, 'ln')}, {_channel(1, '0')}, {_channel(2, 'ln % 3')} FROM (SELECT *, least(floor(pos), {len(_STOPS) - 2})::INT AS k FROM x)),
    bar(k, pr, pg, pb) AS (VALUES {', '.join(str((k, *p)) for k, p in enumerate(palette()))}),
    n AS (SELECT r, g, b, min(d) AS d, arg_min(k, (d, k)) AS k FROM (SELECT r, g, b, k, (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb) AS d FROM (SELECT DISTINCT r, g, b FROM c), bar) GROUP BY 1, 2, 3),
    v AS (SELECT j, i, CASE WHEN d < 324 AND greatest(r, g, b) - least(r, g, b) > 100 THEN k * 1.5625::DOUBLE END AS x FROM c JOIN n USING (r, g, b)),
    m AS (SELECT *, median(x) OVER (PARTITION BY j, i) AS mid FROM v)
    SELECT j, i, {R('CASE WHEN count(x) >= greatest(3, count(*) * 0.3) THEN coalesce(avg(x) FILTER (abs(x - mid) < 10), any_value(mid)) END', 'quantity')}, {R('count(x) / count(*)', 'read')} FROM m GROUP BY 1, 2""",
)
def colours_read(spark, d):
    lines = _t(spark, d, "lineitem").select(*[F.expr(e) for e in atlas._LINES[:2]], (F.col("l_returnflag") == "R").alias("dull"), F.col("l_linenumber").cast("int").alias("ln"), (F.col("l_quantity").cast("double") / 50).alias("x"))
    drawn = lines.groupBy("j", "i", "dull", "ln", "x").agg(F.count("*").alias("n"))
    rgb = [F.when(F.col("dull"), 120).otherwise(c) + m for c, m in zip(scalars.ramp(F.col("x"), _STOPS), (F.col("ln"), F.lit(0), F.col("ln") % 3))]
    drawn = drawn.select("j", "i", "n", *[c.cast("int").alias(a) for c, a in zip(rgb, "rgb")])
    read = drawn.select("j", "i", "n", (scalars.nearest_colour([F.col(a) for a in "rgb"], palette()) * (50.0 / _STEPS)).alias("quantity"))
    return _r(colour_maps.cell_values(read, ["j", "i"], "quantity", "n", within=10.0))
