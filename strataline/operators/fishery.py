"""Activity against its surroundings: the node grid, boxes of a fine grid, periods of months, corrected correlations and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import student_two_sided
from . import ranks, spatial, stats
from .steps import settled


def skeleton(spark, nj: int, ni: int, periods: list[int]) -> DataFrame:
    """j, i, period: every node in every period (a lattice of fixed size)."""
    cells = spark.range(nj * ni).select((F.col("id") / ni).cast("int").alias("j"), (F.col("id") % ni).cast("int").alias("i"))
    return cells.select("j", "i", F.explode(F.array(*[F.lit(p) for p in periods])).alias("period"))


def assembled(grid: DataFrame, parts: list[DataFrame], on: list[str]) -> DataFrame:
    """grid with the columns of each part where it has the node; parts hold one row for each node."""
    for part in parts:
        grid = grid.join(part, [c for c in on if c in part.columns], "left")
    return grid


def deepest(parts: list[DataFrame], on: list[str], depth: str) -> DataFrame:
    """on, dmax: the deepest level that any of the parts has."""
    both = parts[0].select(*on, depth)
    for p in parts[1:]:
        both = both.unionByName(p.select(*on, depth))
    return both.groupBy(*on).agg(F.max(depth).alias("dmax"))


def boxes_of(fine: DataFrame, nodes: DataFrame, ratio: float = 5.0, width: int = 5, offset: float = -2.0) -> DataFrame:
    """fine rows (jx, ix) with the nodes (j, i) whose box of width x width fine cells holds them.

    A node's box starts at the fine index nearest to ratio times its own plus offset. Each node names its cells, so that
    the join is by equality, and boxes may overlap or leave gaps.
    """
    steps = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    own = nodes.select("j", "i", F.bround(F.col("j") * ratio + offset).cast("int").alias("ja"), F.bround(F.col("i") * ratio + offset).cast("int").alias("ia"))
    own = own.select("*", steps.alias("dj")).select("*", steps.alias("di")).select("j", "i", (F.col("ja") + F.col("dj")).alias("jx"), (F.col("ia") + F.col("di")).alias("ix"))
    return fine.join(own, ["jx", "ix"])


def box_aggregate(inside: DataFrame, keys: list[str], value: str, effort: str, foot: str) -> DataFrame:
    return inside.groupBy(*keys).agg(F.avg(value).alias(value), F.sum(effort).alias(effort), F.avg(F.when(F.col(foot) > 0, 1.0).otherwise(0.0)).alias(foot))


def period_effort(monthly: DataFrame, bridge: DataFrame, keys: list[str], ym: str, effort: str) -> DataFrame:
    """keys, period, effort: the sum over a period's months divided by the number of its months in the record, idle ones included."""
    months = monthly.select(F.col(ym).alias("_ym"), F.substring(ym, 6, 2).cast("int").alias("month")).distinct().join(F.broadcast(bridge), "month").groupBy("period").agg(F.count("*").alias("months"))
    rows = monthly.withColumn("month", F.substring(ym, 6, 2).cast("int")).join(F.broadcast(bridge), "month")
    return rows.groupBy(*keys, "period").agg(F.sum(effort).alias("s")).join(F.broadcast(months), "period").select(*keys, "period", (F.col("s") / F.col("months")).alias(effort))


def block_id(lat: Column, lon: Column) -> Column:
    return F.concat_ws("_", F.floor(lat).cast("string"), F.floor(lon).cast("string"))


def corrected_correlation(df: DataFrame, keys: list[str], x: str, y: str, edges: list[float], least: int = 12) -> DataFrame:
    """keys, n, rho, ne, p: rank correlation of cells (lon, lat) with as many degrees of freedom as their autocorrelation leaves.

    The variance is the sum over distance bands of pairs times both Moran indices over n squared, and 1 / n.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rho = stats.spearman(rows, keys, x, y).where(F.col("n") >= least).select(*keys, "n", "rho")
    ranked = ranks.with_rank(ranks.with_rank(rows.select(*keys, "lon", "lat", x, y), keys, x, "_rx"), keys, y, "_ry")
    bands = spatial.band_products(ranked, keys, ["_rx", "_ry"], edges)
    v = bands.groupBy(*keys).agg(F.sum(F.col("pairs") * F.col("i__rx") * F.col("i__ry")).alias("s"))
    out = rho.join(v, keys, "left")
    var = F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("n")) + 1 / F.col("n")
    ne = F.least(F.col("n").cast("double"), F.greatest(F.lit(3.0), F.when(var > 0, 1 + 1 / var).otherwise(F.col("n"))))
    out = out.withColumn("ne", ne)
    t = F.abs("rho") * F.sqrt((F.col("ne") - 2) / F.greatest(F.lit(1e-12), 1 - F.col("rho") * F.col("rho")))
    return out.select(*keys, "n", "rho", "ne", student_two_sided(t, F.col("ne") - 2).alias("p"))


def period_shift(df: DataFrame, node: list[str], period: str, a: int, b: int, value: str, weight: str) -> DataFrame:
    """node, dv, dw, w: change of value from period a to b, of the share of weight in percent, and both weights' sum.

    Of nodes with a row in both periods and some weight in one; shares are of those in both. A missing value leaves dv null.
    """
    at = lambda c, p: F.max(F.when(F.col(period) == p, F.col(c)))
    there = lambda p: F.count_if(F.col(period) == p) > 0
    both = df.where(F.col(period).isin(a, b)).groupBy(*node).agg((there(a) & there(b)).alias("_both"), at(value, a).alias("va"), at(value, b).alias("vb"), at(weight, a).alias("wa"), at(weight, b).alias("wb")).where("_both")
    whole = F.broadcast(both.agg(F.sum("wa").alias("sa"), F.sum("wb").alias("sb")))  # one row
    out = both.join(whole).where("wa > 0 OR wb > 0")
    return out.select(*node, (F.col("vb") - F.col("va")).alias("dv"), (F.try_divide("wb", "sb") * 100 - F.try_divide("wa", "sa") * 100).alias("dw"), (F.col("wa") + F.col("wb")).alias("w"))


def shift_correlation(shift: DataFrame, keys: list[str], least: int = 12) -> DataFrame:
    """keys, n, rho, p, dmean: rank correlation of a period_shift's dv with dw, and the mean of dv by weight; least nodes or more."""
    rows = shift.where("dv IS NOT NULL AND dw IS NOT NULL")
    mean = rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col("dv") * F.col("w")), F.sum("w")).alias("dmean"))
    out = stats.spearman(rows, keys, "dv", "dw").where(F.col("n") >= least).join(mean, keys)
    t = F.abs("rho") * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-12), 1 - F.col("rho") * F.col("rho")))
    return out.select(*keys, "n", "rho", student_two_sided(t, (F.col("n") - 2).cast("double")).alias("p"), "dmean")


def outline(cells: DataFrame, j: str = "j", i: str = "i") -> DataFrame:
    """Cells of the set with a neighbour (left, right, above, below) that isn't in it, and which side that is."""
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.lit(dj).alias("dj"), F.lit(di).alias("di")) for n, dj, di in (("below", -1, 0), ("above", 1, 0), ("left", 0, -1), ("right", 0, 1))])).alias("s")
    near = cells.select(j, i, sides).select(j, i, "s.side", (F.col(j) + F.col("s.dj")).alias("_j"), (F.col(i) + F.col("s.di")).alias("_i"))
    return near.join(cells.select(F.col(j).alias("_j"), F.col(i).alias("_i")), ["_j", "_i"], "left_anti").select(j, i, "side")


def surroundings_median(df: DataFrame, keys: list[str], value: str, half: int = 2) -> DataFrame:
    """keys, j, i, mid: median of the values around each cell of a lattice; beyond an edge its cells count again."""
    d = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    ends = df.groupBy(*keys).agg(*[f(c).alias(f"{c}{n}") for c in ("j", "i") for n, f in ((0, F.min), (1, F.max))])
    inside = lambda c: F.greatest(F.least(F.col(c) + F.col(f"d{c}"), F.col(f"{c}1")), F.col(f"{c}0"))
    near = df.select(*keys, "j", "i").join(ends, keys).select("*", d.alias("dj")).select("*", d.alias("di"))
    near = near.select(*keys, "j", "i", inside("j").alias("_j"), inside("i").alias("_i"))
    have = df.where(F.col(value).isNotNull()).select(*keys, F.col("j").alias("_j"), F.col("i").alias("_i"), F.col(value).alias("_x"))
    return near.join(have, [*keys, "_j", "_i"]).groupBy(*keys, "j", "i").agg(F.median("_x").alias("mid"))


def cleaned(df: DataFrame, keys: list[str], value: str, above: float = 0.6, half: int = 2, rounds: int = 2) -> DataFrame:
    """A lattice (j, i) whose values that exceed their surroundings' median by more than above go, twice over; then that median fills them."""
    at = [*keys, "j", "i"]
    out = df
    for _ in range(rounds):
        mid = surroundings_median(out, keys, value, half)
        out = out.join(mid, at, "left").withColumn(value, F.when(F.coalesce(F.col(value) - F.col("mid") <= above, F.lit(True)), F.col(value))).drop("mid")
    was = df.where(F.col(value).isNotNull()).select(*at, F.lit(True).alias("_was"))
    filled = out.join(surroundings_median(out, keys, value, half), at, "left").join(was, at, "left")
    return filled.withColumn(value, F.coalesce(value, F.when(F.col("_was"), F.col("mid")))).drop("mid", "_was")


def conditions_experienced(df: DataFrame, keys: list[str], values: list[str], weight: str) -> DataFrame:
    """keys, variable, use, avail: mean of each variable by weight, what the activity meets, and the plain mean, what there is.

    Rows without the variable don't count; keys without any weight have no row.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in values])).alias("_v")
    rows = df.select(*keys, F.col(weight).alias("_w"), pairs).where("_v.x IS NOT NULL")
    out = rows.groupBy(*keys, "_v.variable").agg(F.sum("_w").alias("_s"), F.sum(F.col("_v.x") * F.col("_w")).alias("_xw"), F.avg("_v.x").alias("avail"))
    return out.where("_s > 0").select(*keys, "variable", (F.col("_xw") / F.col("_s")).alias("use"), "avail")


def trend_diagnostics(trends: DataFrame, metrics: DataFrame, key: str, trend: str, values: list[str], least: int = 5) -> DataFrame:
    """metric, n, rho, p, slope, intercept: rank correlation and least-squares line of regions' trend over each metric."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("x")) for v in values])).alias("_v")
    rows = trends.select(key, F.col(trend).alias("y")).join(metrics, key).select("y", pairs).select("y", "_v.metric", "_v.x").where("x IS NOT NULL AND y IS NOT NULL")
    rows = settled(rows)  # ranks and lines read it several times
    rank = stats.spearman(rows, ["metric"], "x", "y").where(F.col("n") >= least)
    t = F.abs("rho") * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-12), 1 - F.col("rho") * F.col("rho")))
    return rank.join(stats.ols(rows, ["metric"], "x", "y").drop("n"), "metric").select("metric", "n", "rho", student_two_sided(t, (F.col("n") - 2).cast("double")).alias("p"), "slope", "intercept")
