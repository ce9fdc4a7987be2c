"""Sections, coast and colour maps on small cases worked out by hand or by slow code."""

import datetime
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from strataline.functions import scalars
from strataline.operators import sections
from strataline.sources import colour_maps, profiles_csv


def write_png(path, pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


LAYOUT = colour_maps.Layout(
    bar_column=10, bar_band=(5, 16), bar_rows=(20, 190), low=0.0, high=20.0, tall=150, tall_high=30.0, lons={120.0: 60, 121.0: 100, 122.0: 140}, lats={24.0: 50, 23.0: 90, 22.0: 130},
    plot_rows=(30, 150), plot_columns=(40, 160), slack=4,
)
GRID = colour_maps.Grid(lat0=22.0, lon0=120.0, rows=4, columns=4, step=0.5)
STOPS = [(20, 40, 250), (20, 220, 230), (60, 220, 40), (250, 210, 30), (230, 30, 20)]


def colour(share):
    at = min(max(share, 0), 1) * (len(STOPS) - 1)
    k = min(int(at), len(STOPS) - 2)
    return [int(p + (q - p) * (at - k) + 0.5) for p, q in zip(STOPS[k], STOPS[k + 1])]


def drawn(bar=120, shift=0):
    """A map of 200 x 200 pixels: a bar of so many rows, dark lines moved by shift pixels, a field that warms eastwards."""
    a = np.full((200, 200, 3), 255, np.uint8)
    high = 30.0 if bar > 150 else 20.0
    for k in range(bar):
        a[25 + k, 5:16] = colour(1 - k / (bar - 1))
    for y in range(40, 141):
        for x in range(50, 151):
            a[y, x] = colour(((x - shift - 60) / 40 * 4 + 6) / high)
    a[100:141, 100:151] = 128  # no value in the south east
    for x in (60, 100, 140):
        a[30:150, x + shift] = 0
    for y in (50, 90, 130):
        a[y + shift, 40:160] = 0
    return a


@pytest.mark.parametrize("bar, shift", [(120, 0), (120, 3), (160, -2)])
def test_a_drawn_field_comes_back(spark, tmp_path, bar, shift):
    write_png(tmp_path / "contour_20210304123456.png", drawn(bar, shift))
    pixels = colour_maps.read_colour_maps(spark, str(tmp_path), LAYOUT, GRID)
    got = {(r.j, r.i): r for r in colour_maps.cell_values(pixels, ["day", "j", "i"], "value", "n", within=5.0).collect()}
    assert set(got) == {(j, i) for j in range(4) for i in range(4)}
    assert {r.day for r in got.values()} == {datetime.date(2021, 3, 4)}
    step = (30.0 if bar > 150 else 20.0) / (bar - 1)
    for i in range(4):  # north of the gap: the mean over a cell of half a degree
        assert got[3, i].value == pytest.approx(6 + 4 * (0.5 * i + 0.25), abs=step + 0.15)
    assert got[0, 3].value is None and got[0, 3].read < 0.3


def test_bad_images_are_named(spark, tmp_path):
    blank = np.full((200, 200, 3), 255, np.uint8)
    write_png(tmp_path / "blank.png", blank)
    lost = drawn()
    lost[:, 130:150][lost[:, 130:150].sum(axis=2) == 0] = 255
    lost[:, 96:146, :][lost[:, 96:146].sum(axis=2) == 0] = 255
    write_png(tmp_path / "lines.png", lost)
    (tmp_path / "broken.png").write_bytes(b"no image")
    (tmp_path / "other.txt").write_bytes(b"not asked for")
    rows = colour_maps.read_colour_maps(spark, str(tmp_path), LAYOUT, GRID).collect()
    problems = {r.origin.rsplit("/", 1)[1]: r.problem for r in rows if r.problem}
    assert problems["blank.png"] == "no colour bar" and problems["broken.png"] == "not an image"
    assert all(r.j is None and r.value is None and r.day is None for r in rows if r.problem)
    assert set(problems) <= {"blank.png", "broken.png", "lines.png"}


def test_nearest_colours_are_those_of_all(spark):
    rng = np.random.default_rng(5)
    bar, seen = rng.integers(0, 256, (40, 3)), rng.integers(0, 256, (3000, 3))
    at = colour_maps.Layout(near=60.0)
    d = ((seen[:, None] - bar) ** 2).sum(axis=2)
    want = np.where((d.min(axis=1) < 3600) & (np.ptp(seen, axis=1) > 100), d.argmin(axis=1), -1)
    assert (colour_maps._nearest(seen.astype(np.uint8), bar.astype(float), at) == want).all()
    df = spark.createDataFrame([tuple(map(int, c)) for c in seen[:500]], "r int, g int, b int")
    near = scalars.nearest_colour([F.col(c) for c in "rgb"], [tuple(map(int, c)) for c in bar], near=60.0)
    got = {tuple(r)[:3]: r.k for r in df.select("r", "g", "b", near.alias("k")).collect()}
    assert got == {tuple(map(int, c)): (int(k) if k >= 0 else None) for c, k in zip(seen[:500], want[:500])}


def test_days_in_names(spark):
    names = {"a/x_20210304123456.png": "2021-03-04", "a/2020 1/map 2019-05- 07.png": "2019-05-07", "b/20181231.png": "2018-12-31", "b/map%202017-02-03.png": "2017-02-03", "b/20181399.png": None, "b/none.png": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.d and str(r.d) for r in df.select("n", colour_maps.day_of(F.col("n")).alias("d")).collect()}
    assert got == names


def test_cell_values_of_counts(spark):
    rows = [(1, 10.0, 2), (1, 10.5, 1), (1, 20.0, 1), (2, 5.0, 2), (2, None, 1), (3, 1.0, 3), (3, None, 8), (4, 1.0, 2), (4, 9.0, 2), (5, None, 4)]
    df = spark.createDataFrame(rows, "c int, x double, n long")
    got = {r.c: (r.x, r.read) for r in colour_maps.cell_values(df, ["c"], "x", "n").collect()}
    assert got[1] == (pytest.approx(30.5 / 3), 1.0)
    assert got[2] == (None, pytest.approx(2 / 3))  # two read pixels are too few
    assert got[3] == (None, pytest.approx(3 / 11))  # less than three in ten
    assert got[4] == (5.0, 1.0)  # nothing is near the median: the median itself
    assert got[5] == (None, 0.0)
    assert colour_maps.cell_values(df.where("c > 9"), ["c"], "x", "n").collect() == []


def test_mask_and_coast(spark, tmp_path):
    land = np.zeros((6, 7), bool)
    land[1:5, 1:5] = True
    land[0, 6] = True
    write_png(tmp_path / "land.png", np.repeat(np.where(land, 200, 127).astype(np.uint8)[:, :, None], 3, axis=2))
    mask = colour_maps.read_mask(spark, str(tmp_path))
    assert {(r.y, r.x) for r in mask.where("land").collect()} == {(y, x) for y in range(6) for x in range(7) if land[y, x]}
    got = {(r.y, r.x) for r in sections.coast(mask, ["origin"], "y", "x", "land").collect()}
    want = {(y, x) for y in range(1, 5) for x in range(1, 6) if land[y, x] and not (land[y - 1, x] and land[y + 1, x] and land[y, x - 1] and land[y, x + 1])}
    assert got == want and (2, 2) not in got and (0, 6) not in got
    assert sections.coast(mask.where("y > 9"), ["origin"], "y", "x", "land").collect() == []


def test_section_by_hand(spark):
    cells = [(13, 2, i, p, v) for i in range(6) for p, v in ((0.0, None if i in (0, 5) else i - 2.0), (10.0, 1.0 if i == 2 else None), (30.0, None))]
    df = spark.createDataFrame([*cells, (13, 3, 2, 0.0, 99.0), (14, 2, 1, 0.0, 4.0)], "period int, j int, i int, p double, v double")
    s = spark.createDataFrame([("a", 2, 0, 5, 20.0)], "section string, j int, first int, last int, deepest double")
    rows = sections.section_report(df, s, ["period"], "j", "i", "p", "v", symmetric=True).collect()
    got = {(r.period, r.i, r.p): r for r in rows}
    assert {k[1] for k in got if k[0] == 13} == {0, 1, 2, 3, 4, 5} and (13, 2, 30.0) not in got  # too deep
    top, below = got[13, 2, 0.0], got[13, 2, 10.0]
    assert (top.top, top.base, below.top, below.base) == (0.0, 5.0, 5.0, 10.0)
    assert (top.lo, top.hi, top.shade) == (-2.0, 2.0, 0.5) and got[13, 1, 0.0].shade == 0.25 and got[13, 0, 0.0].shade is None
    assert got[14, 1, 0.0].shade == 1.0  # alone: from -4 to 4
    plain = sections.section_report(df, s, ["period"], "j", "i", "p", "v").where("period = 14").collect()
    assert [(r.lo, r.hi, r.shade) for r in plain] == [(4.0, 4.0, None)]
    assert sections.section_report(df.where("j = 8"), s, ["period"], "j", "i", "p", "v").collect() == []


def test_transport_common_cells(spark):
    rows = [(13, 0, 0.0, 2.0), (13, 1, 0.0, -1.0), (14, 0, 0.0, 4.0), (14, 1, 0.0, None), (0, 0, 0.0, 1.0)]
    df = spark.createDataFrame([(p, 2, i, z, v) for p, i, z, v in rows], "period int, j int, i int, p double, v double")
    s = spark.createDataFrame([("a", 2, 0, 5, 20.0)], "section string, j int, first int, last int, deepest double")
    got = {r.period: r for r in sections.section_transport(df, s, "period", "j", "i", "p", "v", F.lit(1e6), [13, 14]).collect()}
    assert [(got[p].cells, got[p].north, got[p].south, got[p].net, got[p].net_common, got[p].common) for p in (13, 14, 0)] == [(2, 2.0, -1.0, 1.0, 2.0, 1), (1, 4.0, 0.0, 4.0, 4.0, 1), (1, 1.0, 0.0, 1.0, 1.0, 1)]


def test_profiles_last_value_wins_and_rows_are_counted(spark, tmp_path):
    head = "﻿lon,lat,pressure(db),temp_avg(deg.c),sal_avg(psu),time_period\n"
    (tmp_path / "a.csv").write_text(head + "116.0,18.0,10,20.004,34.1,13\n116.0,18.0,10,NaN,34.2,13\n99,18,10,1,1,13\n116.25,18,10,400,33,13\n116.25,18,11,20,33,13\nx,18,10,1,1,13\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text(head + "116.0,18.0,10,21.006,,13\n", encoding="utf-8")
    seen = Observation()
    df = profiles_csv.read_profiles(spark, str(tmp_path), [10.0], [13], scales={"t": 100, "s": 1000}, counts=seen)
    got = {(r.j, r.i): (r.t, r.s) for r in df.collect()}
    assert got == {(0, 0): (21.01, None), (0, 1): (None, None)}  # 34 and 33 by 1000 exceed 16 bits
    assert seen.get == {"rows": 7, "kept": 4}
    assert {(r.j, r.i): (r.t, r.s) for r in profiles_csv.read_profiles(spark, str(tmp_path), [10.0], [13]).collect()} == {(0, 0): (21.006, 34.2), (0, 1): (400.0, 33.0)}
