"""Sources: windows of days with failures and pushed conditions, and merged years."""

import datetime as dt
import http.server
import threading
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.sources import grid_windows as gw
from strataline.sources import netcdf3, years
from test_operators import netcdf

START = dt.date(2001, 1, 1)
LAT, LON = [21.0, 20.0, 19.0], [120.0, 121.0]


def file_of(k, lat=LAT, lon=LON):
    values = np.array([[[100 * (k % 30) + 10 * a + o for o in range(len(lon))] for a in range(len(lat))]])
    t = ((START - dt.date(1970, 1, 1)).days + k) * 86400 + 43200
    return netcdf(values, lat, lon, [t])


@pytest.fixture
def folder(tmp_path):
    for k in range(40):
        (tmp_path / f"{START + gw.DAY * k}.nc").write_bytes(file_of(k))
    return tmp_path


def test_all_days_come_in(spark, folder):
    df = gw.read_windows(spark, base=folder, variable="sst", days=7, pause=0)
    rows = df.collect()
    assert len(rows) == 40 * 6 and {r.error for r in rows} == {None} and df.rdd.getNumPartitions() == 6
    assert {(r.day - START).days: r.value for r in rows if r.lat == 19.0 and r.lon == 121.0} == {k: pytest.approx(k % 30 + 0.21) for k in range(40)}
    assert gw.extent(str(folder)) == (START, START + gw.DAY * 39)
    r = gw.check_source(df).first()
    assert (r.days, r.values, r.failed) == (40, 240, 0)


def test_conditions_reach_the_requests(spark, folder):
    df = gw.read_windows(spark, base=folder, variable="sst", days=7, pause=0)
    some = df.where((F.col("day") >= "2001-01-10") & (F.col("day") < "2001-01-13") & (F.col("lat") > 19.0) & (F.col("lon") == 121.0) & (F.col("value") > 0))
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.split("\n") if "Filter (" in line]
    assert len(left) == 1 and "value#" in left[0] and not any(f"{c}#" in left[0] for c in ("day", "lat", "lon")), plan
    assert sorted((r.day.day, r.lat, r.lon) for r in some.collect()) == [(d, a, 121.0) for d in (10, 11, 12) for a in (20.0, 21.0)]
    assert some.rdd.getNumPartitions() == 1
    r = gw.Request.of({"base": str(folder), "variable": "sst"})
    for f in (gw.GreaterThan(("day",), START), gw.EqualTo(("lat",), 20.0), gw.LessThan(("lon",), 121.0)):
        assert r.narrow(f)
    assert not r.narrow(gw.GreaterThan(("value",), 1.0))
    assert (r.start, r.box) == (START + gw.DAY, {"lat": [20.0, 20.0], "lon": [-180.0, 121.0]})
    assert r.windows()[0] == (START + gw.DAY, START + gw.DAY * 30)


def test_failures_are_halved_and_recorded(spark, folder):
    (folder / f"{START + gw.DAY * 9}.nc").write_bytes(b"no file of this kind")
    (folder / f"{START + gw.DAY * 25}.nc").unlink()
    rows = gw.read_windows(spark, base=folder, variable="sst", days=16, least_days=2, retries=1, pause=0).collect()
    failed = sorted((r.day, r.until, r.error) for r in rows if r.error)
    assert [((a - START).days, (b - START).days) for a, b, _ in failed] == [(8, 9), (24, 25)]
    assert "ValueError" in failed[0][2] and "FileNotFoundError" in failed[1][2]
    assert {(r.day - START).days for r in rows if not r.error} == set(range(40)) - {8, 9, 24, 25}


def test_retries_and_giving_up(folder):
    r = gw.Request.of({"base": str(folder), "variable": "sst", "retries": "2", "pause": "0", "least_days": "1", "give_up": "3"})
    calls = []

    def flaky(r, a, b):
        calls.append((a, b))
        if len(calls) < 3:
            raise OSError("later")
        return gw.fetch(r, a, b)

    assert len(gw.asked(r, START, START, flaky)[0]) == 6 and len(calls) == 3

    def never(r, a, b):
        calls.append((a, b))
        raise OSError("never")

    calls.clear()
    rows = [x for b in gw.window_rows(r, START, START + gw.DAY * 15, never) for x in b.to_pylist()]
    days = sorted((x["day"], x["until"]) for x in rows)
    assert sum((b - a).days + 1 for a, b in days) == 16 and len(calls) < 30
    assert sum("not asked for" in x["error"] for x in rows) == len(rows) - 3


def test_a_server(spark, folder):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            path = urllib.parse.unquote(self.path)
            seen.append(path)
            if path.endswith(".das"):
                body = b"s { time { String a \"b\"; Float64 actual_range 9.783072e+8, 9.785664e+8; } }"
            else:
                k = (dt.date.fromisoformat(path.split("[(")[1][:10]) - START).days
                body = file_of(k)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_address[1]}/grid"
        rows = gw.read_windows(spark, base=base, variable="other_name", days=1, level=0, stride=2, pause=0).where("lat >= 20").collect()
    finally:
        server.shutdown()
    assert sorted({r.day.isoformat() for r in rows}) == ["2001-01-01", "2001-01-02", "2001-01-03", "2001-01-04"] and len(rows) == 16
    assert "/grid.nc?other_name[(2001-01-02T00:00:00Z):1:(2001-01-02T23:59:59Z)][(0)][(20):2:(90)][(-180):2:(360)]" in seen


def test_harvest_asks_again_only_for_what_failed(spark, folder, tmp_path):
    gone = folder / f"{START + gw.DAY * 12}.nc"
    raw = gone.read_bytes()
    gone.unlink()
    out, how = str(tmp_path / "kept"), dict(base=folder, variable="sst", days=10, least_days=1, retries=0, pause=0)
    first = gw.harvest(spark, out, **how)
    assert first.where("error is not null").count() == 1 and first.where("error is null").count() == 39 * 6
    gone.write_bytes(raw)
    (folder / f"{START}.nc").unlink()  # of a window that is whole already
    again = gw.harvest(spark, out, **how, start=START, end=START + gw.DAY * 39)
    assert again.where("error is not null").count() == 0 and again.count() == 40 * 6


def test_merged_years(spark, tmp_path):
    day = lambda y, n: dt.date(y, 1, n)
    out = str(tmp_path / "years")
    rows = lambda *x: spark.createDataFrame(x, "cell int, day date, v double, seq int")
    years.merge_years(rows((1, day(2001, 1), 1.0, 2), (1, day(2001, 1), 0.5, 1), (1, day(2002, 1), 3.0, 1)), out, ["cell"], order=["seq"])
    more = rows((1, day(2001, 1), 9.0, 0), (2, day(2001, 1), 4.0, 0), (None, day(2003, 5), None, 0))
    want = [(1, day(2001, 1), 0.5), (1, day(2002, 1), 3.0), (2, day(2001, 1), 4.0), (None, day(2003, 5), None)]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "years" / "year=2002").glob("part-*")}
    for _ in range(2):
        got = years.merge_years(more, out, ["cell"], order=["seq"])
        assert sorted(((r.cell, r.day, r.v) for r in got.collect()), key=str) == sorted(want, key=str)
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "years" / "year=2002").glob("part-*")}


def test_arrays_of_a_grid():
    day, lat, lon, x = netcdf3.grid_arrays(file_of(3), "sst", quantum=0.5)
    assert set(day) == {(START - dt.date(1970, 1, 1)).days + 3} and lat.tolist() == [19.0, 19.0, 20.0, 20.0, 21.0, 21.0] and x.tolist() == [3.0] * 6
