"""Reports that bring the field and the atlas together: what activity experiences, and trends against what lies below."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fishery, hydro
from . import atlas, ocean
from .climate import R, _r
from .registry import register

_EXPERIENCED = f"""WITH {atlas._ATLAS}, {atlas._MLD}, n AS (SELECT j, i, period, max(t) FILTER (p = 0) AS t0, max(t) FILTER (p = 50) AS t50, max(v) FILTER (p = 0) AS v0, max(eff) AS eff FROM atlas GROUP BY 1, 2, 3),
    m AS (SELECT n.*, mld FROM n LEFT JOIN mld USING (j, i, period)), x AS ({' UNION ALL '.join(f"SELECT period, eff, '{v}' AS variable, {v} AS x FROM m" for v in ('t0', 't50', 'v0', 'mld'))})
    SELECT period, variable, {R('sum(x * eff) / sum(eff)', 'use')}, {R('avg(x)', 'avail')} FROM x WHERE x IS NOT NULL GROUP BY 1, 2 HAVING sum(eff) > 0"""


def _at(x: str, level: float):
    return F.max(F.when(F.col("p") == level, F.col(x)))


@register("conditions_experienced", _EXPERIENCED)
def conditions_experienced(spark, d):
    a = atlas.atlas(spark, d)
    nodes = a.groupBy(*atlas.NODE).agg(_at("t", 0).alias("t0"), _at("t", 50).alias("t50"), _at("v", 0).alias("v0"), F.max("eff").alias("eff"))
    both = nodes.join(hydro.mixed_layer(a, atlas.NODE, "p", "t"), atlas.NODE, "left")
    return _r(fishery.conditions_experienced(both, ["period"], ["t0", "t50", "v0", "mld"], "eff"))


_DIAGNOSTICS = f"""WITH {ocean._STATS}, {atlas._DSIG}, {atlas._MLD},
    below AS (SELECT j AS cell, avg(dsig) AS dsig, avg(mld) AS mld, avg(t) AS t FROM (SELECT DISTINCT j, i, period FROM atlas) LEFT JOIN (SELECT j, i, period, dsig FROM dsig) USING (j, i, period) LEFT JOIN mld USING (j, i, period)
      LEFT JOIN (SELECT j, i, period, t FROM atlas WHERE p = 20) USING (j, i, period) GROUP BY 1),
    m AS (SELECT trend AS y, dsig, below.mld, t FROM stats JOIN below USING (cell)), x AS ({' UNION ALL '.join(f"SELECT y, '{v}' AS metric, {v} AS x FROM m" for v in ('dsig', 'mld', 't'))}), r AS (SELECT *, {atlas._rank('x', 'metric')} AS a, {atlas._rank('y', 'metric')} AS b FROM x WHERE x IS NOT NULL AND y IS NOT NULL),
    s AS (SELECT metric, count(*)::BIGINT AS n, corr(a, b) AS rho, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM r GROUP BY 1 HAVING count(*) >= 5)
    SELECT metric, n, {R('rho', 'rho')}, {R(atlas._tail('abs(rho) * sqrt((n - 2) / greatest(1e-12, 1 - rho * rho))', '(n - 2)'), 'p')}, {R('slope', 'slope')}, {R('intercept', 'intercept')} FROM s"""


@register("trend_diagnostics", _DIAGNOSTICS)
def trend_diagnostics(spark, d):
    a = atlas.atlas(spark, d)
    nodes = a.groupBy(*atlas.NODE).agg(_at("t", 20).alias("t"))
    nodes = nodes.join(hydro.density_difference(a, atlas.NODE, "p", "sg"), atlas.NODE, "left").join(hydro.mixed_layer(a, atlas.NODE, "p", "t"), atlas.NODE, "left")
    below = nodes.groupBy(F.col("j").alias("cell")).agg(F.avg("dsig").alias("dsig"), F.avg("mld").alias("mld"), F.avg("t").alias("t"))
    return _r(fishery.trend_diagnostics(ocean._stats(spark, d), below, "cell", "trend", ["dsig", "mld", "t"]))
