"""Use against availability, on series worked out by slow code."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.operators import events, usage


def test_use_series_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 1), ("a", 4.0, 1.0, 2), ("a", None, 3.0, 2), ("a", 7.0, None, 3), ("b", 5.0, 0.0, 1)], "ym string, x double, w double, ship int")
    got = {r.ym: (r.use, r.avail, r.per_unit) for r in usage.use_series(df, ["ym"], "x", "w", "ship").collect()}
    assert got == {"a": (2.0, 4.0, 3.0), "b": (None, 5.0, None)}
    assert usage.use_series(df.where("ym = 'c'"), ["ym"], "x", "w", "ship").collect() == []


def test_tracking_tells_following_from_staying(spark):
    rng = np.random.default_rng(3)
    season = np.tile(np.arange(12), 6)
    avail = 24 + 4 * np.cos(season / 6 * np.pi) + rng.normal(0, 0.5, 72)
    rows = [("stays", int(s), float(a), float(a)) for s, a in zip(season, avail)] + [("follows", int(s), float(a), 25.0 + 0.1 * float(a - 24)) for s, a in zip(season, avail)]
    df = spark.createDataFrame([*rows, ("stays", 1, None, 4.0)], "who string, season int, avail double, use double")
    got = {r.who: r for r in usage.tracking(df, ["who"], "season").collect()}
    assert got["stays"].slope == pytest.approx(1.0) and got["stays"].season_slope == pytest.approx(1.0) and got["stays"].n == 72
    assert got["follows"].slope == pytest.approx(0.1) and got["follows"].r == pytest.approx(1.0)


def test_trend_with_autocorrelated_residuals(spark):
    rng = np.random.default_rng(11)
    series = {}
    for name, phi in (("white", 0.0), ("red", 0.8)):
        e = [0.0]
        for _ in range(39):
            e.append(phi * e[-1] + rng.normal(0, 0.3))
        series[name] = np.arange(40) * 0.02 + np.array(e)
    rows = [(n, 1980 + k, float(v)) for n, y in series.items() for k, v in enumerate(y) if (n, k) != ("red", 17)]
    df = spark.createDataFrame([*rows, ("white", 2030, None), ("short", 1990, 1.0), ("line", 1990, 1.0)] + [("line", 1990 + k, 1.0 + k) for k in range(1, 6)], "who string, year int, y double")
    got = {r.who: r for r in usage.autocorrelated_trend(df, ["who"], "year", "y").collect()}
    assert set(got) == {"white", "red", "line"}
    for name, y in series.items():
        x = np.array([1980.0 + k for k in range(40) if (name, k) != ("red", 17)])
        v = np.array([y[int(k - 1980)] for k in x])
        b, a = np.polyfit(x, v, 1)
        e = v - a - b * x
        r1 = sum(e[k] * e[k - 1] for k in range(1, len(x)) if x[k] - x[k - 1] == 1) / (e @ e)
        ne = min(len(x), max(3, len(x) * (1 - r1) / (1 + r1)))
        se = np.sqrt(e @ e / (ne - 2) / ((x - x.mean()) ** 2).sum())
        r = got[name]
        assert (r.n, r.slope, r.r1, r.ne, r.ci95) == (len(x), pytest.approx(10 * b), pytest.approx(r1, abs=1e-6), pytest.approx(ne, rel=1e-6), pytest.approx(19.6 * se, rel=1e-6))
    assert got["red"].ne < got["white"].ne
    assert got["line"].slope == pytest.approx(10.0) and got["line"].ci95 == pytest.approx(0.0, abs=1e-6)


def test_spread_and_shares(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(1, 9)] + [("b", 100.0), ("b", None), (None, 3.0)], "g string, x double")
    got = {r.g: (r.n, r.p25, r.p50, r.p75, r.apart) for r in usage.group_spread(df, "g", "x").collect()}
    assert got["a"] == (8, 3.0, 5.0, 7.0, 0.0) and got["b"] == (1, 100.0, 100.0, 100.0, 95.0) and got[None][:2] == (1, 3.0)
    near = spark.createDataFrame([(1, 5.0, 2.0), (1, 10.0, 6.0), (1, 11.0, 2.0), (1, None, 50.0), (2, 3.0, 0.0)], "k int, km double, w double")
    assert {r.k: (r.use, r.avail) for r in usage.near_share(near, ["k"], "km", "w", 10.0).collect()} == {1: (0.8, pytest.approx(2 / 3)), 2: (None, 1.0)}


def test_stars_stand_where_the_correlation_holds(spark):
    rng = np.random.default_rng(2)
    lon, lat = np.meshgrid(120 + np.arange(8), 20 + np.arange(8))
    effort = rng.integers(0, 50, 64)
    df = spark.createDataFrame([(1, float(o), float(a), float(e), float(n), int(e)) for o, a, e, n in zip(lon.ravel(), lat.ravel(), effort, rng.normal(0, 1, 64))], "k int, lon double, lat double, tied double, loose double, eff int")
    got = {r.variable: r for r in usage.selectivity_map(df, ["k"], ["tied", "loose"], "eff", [0.0, 150.0, 300.0]).collect()}
    assert got["tied"].star and got["tied"].stars == "***" and got["tied"].si > 0.3 and got["tied"].rho == pytest.approx(1.0)
    assert not got["loose"].star and abs(got["loose"].si) < 0.5
    assert usage.selectivity_map(df.where("k = 2"), ["k"], ["tied"], "eff", [0.0, 150.0]).collect() == []


def test_days_in_events(spark):
    day = lambda k: datetime.date(2020, 1, k)
    days = spark.createDataFrame([("a", day(k), float(k)) for k in range(1, 7)] + [("b", day(3), 1.0)], "r string, day date, x double")
    found = spark.createDataFrame([("a", day(2), day(3)), ("a", day(5), day(5))], "r string, start date, stop date")
    got = {(r.r, r.day.day): r.event and r.event.day for r in events.on_days(days, found, ["r"], "day").collect()}
    assert got == {("a", 1): None, ("a", 2): 2, ("a", 3): 2, ("a", 4): None, ("a", 5): 5, ("a", 6): None, ("b", 3): None}
    assert events.on_days(days, found.where(F.lit(False)), ["r"], "day").where("event is not null").collect() == []
