"""Edges of the core operators, by hand."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.functions import scalars
from strataline.operators import hydro, planes, profile, stats


def test_students_tail(spark):
    rows = [(t, d) for t in (0.0, 0.1, 1.0, 2.5, 8.0) for d in (1.0, 1.5, 3.0, 10.0, 57.3, 1000.0)]
    df = spark.createDataFrame(rows, "t double, d double")
    for r in df.select("t", "d", scalars.student_two_sided(F.col("t"), F.col("d")).alias("p")).collect():
        angle = np.linspace(0, math.atan(r.t / math.sqrt(r.d)), 100_001)
        scale = math.exp(math.lgamma((r.d + 1) / 2) - math.lgamma(r.d / 2)) / math.sqrt(math.pi)
        assert r.p == pytest.approx(1 - 2 * scale * np.trapezoid(np.cos(angle) ** (r.d - 1), angle), abs=1e-7)


def test_isotherm_that_the_surface_only_touches(spark):
    rows = [(k, p, t) for k, ts in (("touch", [20.0, 19.0, 18.0, 15.0]), ("cross", [21.0, 19.0, 18.0, 15.0])) for p, t in zip([0, 20, 40, 80], ts)]
    got = {r.k: r.iso for r in profile.profile_metrics(spark.createDataFrame(rows, "k string, p int, t double"), ["k"]).collect()}
    assert got == {"touch": None, "cross": 10.0}


def test_planes_round_trip(spark):
    values = [1.23, None, -327.67, 400.0, -400.0, 0.0]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "k int, at int, v double")
    plane = planes.to_plane(df, ["k"], ["at"], scalars.quantised(F.col("v")))
    got = [r.value for r in planes.from_plane(plane, ["k"], "plane").orderBy("at").collect()]
    assert got == [1.23, None, -327.67, 327.67, -327.67, 0.0]


def test_windows_that_failed_are_halved(spark):
    day = lambda n: dt.date(2020, 1, n)
    df = spark.createDataFrame([(1, day(1), day(9)), (2, day(1), day(4))], "k int, a date, b date")
    assert sorted((r.k, r.a.day, r.b.day) for r in planes.halves(df).collect()) == [(1, 1, 4), (1, 5, 9), (2, 1, 4)]


def test_contours_of_one_square(spark):
    def of(a, b, d, c):
        df = spark.createDataFrame([(0, 0, a), (0, 1, b), (1, 0, d), (1, 1, c)], "j int, i int, t double")
        return sorted((r.x0, r.y0, r.x1, r.y1) for r in hydro.contour_segments(df, [], "j", "i", "t", 0.0).collect())

    assert of(-1.0, 1.0, -1.0, 1.0) == [(0.5, 0.0, 0.5, 1.0)]
    assert len(of(-1.0, 1.0, 1.0, -1.0)) == 2 and of(1.0, 1.0, 1.0, 1.0) == [] and of(None, 1.0, -1.0, 1.0) == []


def test_rules_of_order_statistics(spark):
    df = spark.createDataFrame([(0, float(v)) for v in [5, 1, 3, 2, 4, 4]], "k int, v double")
    for rule, want in (("floor_n", 4.0), ("round", 4.0), ("floor", 3.0)):
        assert stats.order_statistics(df, ["k"], "v", {"m": 0.5}, rule).first().m == want


def test_small_expressions(spark):
    r = spark.range(1).select(
        scalars.eddy_energy(F.lit(3.0), F.lit(4.0)).alias("e"), scalars.shear(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0), F.lit(25.0)).alias("s"), scalars.shear(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0), F.lit(19.0)).alias("near"),
        scalars.decoded_bytes(F.lit(50), 8.0, 10.0).alias("b"), scalars.decoded_bytes(F.lit(255), 8.0, 10.0).alias("gone"), scalars.rescaled(F.lit(30.0), F.lit(True)).alias("r"), scalars.quantised(F.lit(None).cast("double")).alias("q"),
    ).first()
    assert (r.e, r.s, r.near, r.b, r.gone, r.r, r.q) == (12.5, 200.0, None, 13.0, None, 35.0, -32768)


def test_mixed_layer_needs_its_reference(spark):
    rows = [("deep", p, t) for p, t in ((20.0, 20.0), (40.0, 15.0))] + [("whole", p, t) for p, t in ((0.0, 20.0), (20.0, 19.0), (40.0, 15.0))]
    got = {r.k: (r.mld, r.bottom) for r in hydro.mixed_layer(spark.createDataFrame(rows, "k string, p double, t double"), ["k"], "p", "t").collect()}
    assert got == {"deep": (40.0, True), "whole": (40.0, False)}


def test_crossings_at_an_exact_zero(spark):
    df = spark.createDataFrame([(0, float(x), v) for x, v in enumerate([1.0, 0.0, 0.0, 2.0, -2.0, None, -1.0])], "k int, x double, v double")
    assert sorted(r.at for r in hydro.zero_crossings(df, ["k"], "x", "v").collect()) == [1.0, 2.0, 3.5]


def test_cleaning_of_a_lattice(spark):
    from strataline.operators import fishery

    r = np.random.default_rng(3)
    o = np.round(r.normal(size=(6, 7)), 3)
    o[r.random((6, 7)) < 0.2] = np.nan
    o[2, 3] = 9.0

    def around(x):
        p = np.pad(x, 2, mode="edge")
        return np.array([[np.nanmedian(p[j : j + 5, i : i + 5]) for i in range(7)] for j in range(6)])

    want = o.copy()
    for _ in range(2):
        want[want - around(want) > 0.6] = np.nan
    fill = np.isfinite(o) & ~np.isfinite(want)
    want[fill] = around(want)[fill]
    df = spark.createDataFrame([(0, j, i, None if np.isnan(o[j, i]) else float(o[j, i])) for j in range(6) for i in range(7)], "k int, j int, i int, t double")
    for x in fishery.cleaned(df, ["k"], "t").collect():
        assert (x.t is None) == bool(np.isnan(want[x.j, x.i])) and (x.t is None or x.t == pytest.approx(want[x.j, x.i]))


def test_shift_between_periods(spark):
    from strataline.operators import fishery

    rows = [(n, p, float(n * p % 7) if n != 3 else None, float((n * p) % 5)) for n in range(20) for p in (17, 18) if not (n == 4 and p == 18)] + [(50, 17, 1.0, 0.0), (50, 18, 2.0, 0.0)]
    got = {r.n: r for r in fishery.period_shift(spark.createDataFrame(rows, "n int, p int, v double, w double"), ["n"], "p", 17, 18, "v", "w").collect()}
    two = {n: [(v, w) for m, _, v, w in rows if m == n] for n in range(51)}
    two = {n: x for n, x in two.items() if len(x) == 2}
    sa, sb = (sum(x[k][1] for x in two.values()) for k in (0, 1))
    assert got.keys() == {n for n, x in two.items() if x[0][1] > 0 or x[1][1] > 0} and 50 not in got and 4 not in got
    for n, r in got.items():
        assert r.dw == pytest.approx(two[n][1][1] / sb * 100 - two[n][0][1] / sa * 100) and (r.dv is None) == (n == 3)
    (t,) = fishery.shift_correlation(fishery.period_shift(spark.createDataFrame(rows, "n int, p int, v double, w double"), ["n"], "p", 17, 18, "v", "w").withColumn("all", F.lit(0)), ["all"]).collect()
    have = [r for r in got.values() if r.dv is not None]
    assert t.n == len(have) and t.dmean == pytest.approx(sum(r.dv * r.w for r in have) / sum(r.w for r in have)) and 0 <= t.p <= 1


def test_ranks_and_running_sums(spark):
    from strataline.operators import ranks

    r = np.random.default_rng(1)
    rows = [(k, float(v)) for k in (0, 1, None) for v in r.integers(0, 40, 200)] + [(2, 5.0)] * 500 + [(3, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    for k in (0, 1, None, 2):
        vs = np.array([v for x, v in rows if x == k])
        got = {x.v: (x.rank, x.n) for x in ranks.distinct_ranks(df, ["k"], "v").withColumnRenamed("count", "n").collect() if x.k == k}
        assert got == {v: ((vs < v).sum() + ((vs == v).sum() + 1) / 2, (vs == v).sum()) for v in set(vs)}
    out = ranks.with_rank(df, ["k"], "v", "r").collect()
    assert len(out) == len(rows) and [x.r for x in out if x.k == 3] == [None] and {x.r for x in out if x.k == 2} == {250.5}
    every = {x.v: x.rank for x in ranks.distinct_ranks(df, [], "v").collect()}
    vs = np.array([v for _, v in rows if v is not None])
    assert every[5.0] == (vs < 5).sum() + ((vs == 5).sum() + 1) / 2
    assert ranks.with_rank(df.where("false"), ["k"], "v", "r").count() == 0


def test_neighbours_as_by_all_pairs(spark):
    from strataline.operators import spatial

    r = np.random.default_rng(4)
    km = lambda a, b: math.hypot((a[0] - b[0]) * math.cos(math.radians(25)), a[1] - b[1]) * 111.2
    at = [(int(k % 2), float(x), float(y), float(v)) for k, (x, y, v) in enumerate(zip(r.uniform(100, 125, 160), r.uniform(-30, 60, 160), r.normal(size=160)))]
    goals = [(0, 110.0, 20.0), (0, 110.1, 20.0), (1, 101.0, 59.0)]
    df = spark.createDataFrame([*at, (2, 100.0, 0.0, 1.0)], "k int, lon double, lat double, v double")
    t = spark.createDataFrame(goals, "k int, lon double, lat double")
    for x in spatial.nearest_distance(df, t, ["k"]).collect():
        want = [km((x.lon, x.lat), g[1:]) for g in goals if g[0] == x.k]
        assert (x.km is None and x.k == 2) or x.km == pytest.approx(min(want))
    edges = [0.0, 200.0, 500.0, 900.0]
    for x in spatial.moran_bands(df, ["k"], "v", edges).collect():
        mine = [a for a in at if a[0] == x.k]
        z = np.array([a[3] for a in mine]) - np.mean([a[3] for a in mine])
        pairs = [z[i] * z[j] for i, a in enumerate(mine) for j, b in enumerate(mine) if edges[x.band] < km(a[1:3], b[1:3]) <= edges[x.band + 1]]
        assert x.pairs == len(pairs) and x.i == pytest.approx(np.mean(pairs) / np.mean(z * z))
