"""The binary atlas and the analysis document: round trips, damaged files, single planes."""

import json

import numpy as np
import pytest


from strataline.sources import analysis_doc as ad
from strataline.sources import atlas_file as af

LAYOUT = af.Layout(116.0, 18.0, 0.25, 5, 4, [0, 13], [([("T", 100.0), ("S", 1000.0)], [0.0, 5.0, 10.0]), ([("U", 1000.0)], [10.0, 20.0])])


@pytest.fixture
def atlas(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(v, p, lev, j, i, None if r.random() < 0.2 else float(r.normal(scale=8))) for v, _, levels, _ in LAYOUT.variables() for p in LAYOUT.periods for lev in levels for j in range(4) for i in range(5) if (v, p, lev) != ("T", 13, 5.0)]
    rows += [("T", 0, 0.0, 9, 0, 1.0), ("X", 0, 0.0, 0, 0, 1.0), ("T", 0, 7.0, 0, 0, 1.0), ("U", 13, 20.0, 0, 0, 99.0)]
    path = str(tmp_path / "atlas.bin")
    af.write_atlas(spark.createDataFrame(rows, "variable string, period int, level double, j int, i int, value double"), path, LAYOUT)
    return path, rows


def test_atlas_round_trip(spark, atlas):
    path, rows = atlas
    want = {}
    for v, p, lev, j, i, x in rows:
        scale = {"T": 100, "S": 1000, "U": 1000}.get(v)
        if scale and j < 4 and lev != 7.0 and x is not None:
            want[v, p, lev, j, i] = max(want.get((v, p, lev, j, i), -99), max(-32767, min(32767, round(x * scale))) / scale)
    got = af.read_atlas(spark, path).collect()
    assert len(got) == (2 * 3 + 2) * 2 * 20
    assert {(r.variable, r.period, r.level, r.j, r.i): r.value for r in got if r.value is not None} == pytest.approx(want)
    assert all(r.value is None for r in got if (r.variable, r.period, r.level) == ("T", 13, 5.0))
    assert {(r.lon, r.lat) for r in got if (r.j, r.i) == (1, 2)} == {(116.5, 18.25)}
    shares = {r.variable: (r.nodes, r.valid) for r in af.valid_shares(af.read_atlas(spark, path)).collect()}
    assert shares["U"] == (80, pytest.approx(sum(k[0] == "U" for k in want) / 80))


def test_one_plane_is_read_without_the_rest(spark, atlas, tmp_path):
    path, _ = atlas
    raw = open(path, "rb").read()
    places = {n: at for n, _, _, at in af.read_layout(path).variables()}
    # all but one plane is damaged: what is asked for doesn't come near it
    at = places["S"] + LAYOUT.plane * (3 + 2)
    bad = tmp_path / "bad.bin"
    bad.write_bytes(raw[: af.read_layout(path).begin] + b"\1" * (at - af.read_layout(path).begin) + raw[at : at + LAYOUT.plane] + b"\1" * (len(raw) - at - LAYOUT.plane))
    one = lambda p: af.read_atlas(spark, str(p)).where("variable = 'S' AND period = 13 AND level > 5")
    assert sorted(map(tuple, one(bad).collect()), key=str) == sorted(map(tuple, one(path).collect()), key=str) and one(bad).count() == 20
    assert one(path).rdd.getNumPartitions() == 1 and "Filter (" not in one(path)._jdf.queryExecution().executedPlan().toString()
    assert af.read_atlas(spark, path).where("variable = 'nothing'").count() == 0


def test_damaged_atlases(spark, atlas, tmp_path):
    raw = open(atlas[0], "rb").read()
    for k, (bad, why) in enumerate([(b"NOPE" + raw[4:], "isn't a binary atlas"), (raw[:-1], "ends before"), (raw[:40], "within its header"), (raw[:4] + b"\7" + raw[5:], "version"), (b"", "isn't")]):
        p = tmp_path / f"bad{k}"
        p.write_bytes(bad)
        with pytest.raises(Exception, match=why):
            af.read_atlas(spark, str(p)).collect()


def test_document_round_trip(spark, tmp_path):
    r = np.random.default_rng(2)
    cells = [(k, *[None if r.random() < 0.1 else float(r.normal(scale=5)) for _ in range(2)], float(r.random()), 400.0 if k == 3 else float(k)) for k in range(30)]
    series = [(g, k, float(r.normal()), None if k == 4 else 1.5) for g in ("north \"x\"", "south") for k in range(9)]
    events = [("south", k, f"2001-01-0{k + 1}", 5 + k) for k in range(3)]
    c = spark.createDataFrame(cells, "cell int, mean double, trend double, p double, phase double")
    s = spark.createDataFrame(series, "region string, day int, v double, ano double")
    e = spark.createDataFrame(events, "region string, n int, start string, dur int")
    parts = ad.plane_parts(c, "cells", ["cell"], {"mean": "mean", "trend": "trend", "trendP": "p", "phase": "phase"})
    parts = parts.unionByName(ad.plane_parts(s, "series", ["day"], {"v": "v", "ano": "ano"}, "region")).unionByName(ad.list_parts(e, "mhw", ["n"], ["start", "dur"], "region"))
    path = str(tmp_path / "doc")
    ad.write_document(parts.repartition(5), path, {"meta": {"src": "made 海", "nday": 9}, "regions": [{"id": "south"}]}, ["cells", "series", "mhw", "hov"])
    files = list((tmp_path / "doc").glob("part-*"))
    doc = json.loads("".join(f.read_text() for f in files))
    assert list(doc) == ["meta", "regions", "cells", "series", "mhw", "hov"] and doc["meta"]["src"] == "made 海" and doc["hov"] == {}
    assert set(doc["cells"]) == {"mean", "trend", "trendP", "phase"} and set(doc["series"]) == {"north \"x\"", "south"}
    assert doc["mhw"] == {"south": [{"start": f"2001-01-0{k + 1}", "dur": 5 + k} for k in range(3)]}
    plane = lambda t, k: [None if x == -32768 else x / k for x in np.frombuffer(__import__("base64").b64decode(t), "<i2").tolist()]
    near = lambda a, b, k: (a is None) == (b is None) and (a is None or abs(a - b) <= 0.5 / k + 1e-9)
    for n, k, at in (("mean", 100, 1), ("trend", 100, 2), ("trendP", 10000, 3), ("phase", 10, 4)):
        assert all(near(a, x[at], k) for a, x in zip(plane(doc["cells"][n], k), cells))
    back = ad.read_document(spark, path, "meta struct<nday:int>, cells struct<mean:string,trendP:string,phase:string>")
    assert back.count() == 1 and back.first().meta.nday == 9
    got = {(x.name, x.at): x.value for x in ad.document_planes(back, {"mean": "cells.mean", "trendP": "cells.trendP", "phase": "cells.phase"}).collect()}
    assert len(got) == 90
    for n, k, at in (("mean", 100, 1), ("trendP", 10000, 3), ("phase", 10, 4)):
        assert all(near(got[n, q], x[at], k) for q, x in enumerate(cells))


def test_document_without_parts(spark, tmp_path):
    none = spark.createDataFrame([], "group string, member string, name string, text string")
    ad.write_document(none, str(tmp_path / "doc"), {"meta": {}}, ["cells"])
    assert json.loads("".join(f.read_text() for f in (tmp_path / "doc").glob("part-*"))) == {"meta": {}, "cells": {}}
