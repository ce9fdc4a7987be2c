import datetime as dt
import struct

import numpy as np
import pytest

from strataline.operators import events, trend
from strataline.sources import netcdf3, profiles_csv
from strataline.streaming import windows


def test_spells_merge_after_the_length_filter(spark):
    hot = {*range(10, 16), *range(18, 24), *range(30, 34), *range(40, 46), *range(49, 55)}
    day0 = dt.date(2001, 1, 1)
    rows = [("x", day0 + dt.timedelta(d), 2.0 if d in hot else 0.0, 1.0) for d in range(70)]
    df = spark.createDataFrame(rows, "k string, day date, v double, thr double")
    got = sorted(((r.start - day0).days, (r.stop - day0).days) for r in events.spells(df, ["k"], "day", "v").collect())
    assert got == [(10, 23), (40, 45), (49, 54)]


def test_trend_of_a_line(spark):
    df = spark.createDataFrame([("a", x, 3.0 + 0.5 * x) for x in range(12)] + [("b", 1, 1.0)], "k string, x int, y double")
    (r,) = trend.sen_trend(df, ["k"], "x", "y").collect()
    assert (r.k, r.slope, r.s) == ("a", 0.5, 66) and r.p < 1e-4


def netcdf(values, lat, lon, t, version=1):
    name = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    attr = lambda n, kind, raw, k: name(n) + struct.pack(">ii", kind, k) + raw.ljust(-(-len(raw) // 4) * 4, b"\0")
    nt, ny, nx = values.shape
    data = [np.array(t, ">f8").tobytes(), np.array(lat, ">f4").tobytes(), np.array(lon, ">f4").tobytes(), values.astype(">i2").tobytes()]
    data = [x.ljust(-(-len(x) // 4) * 4, b"\0") for x in data]
    attrs = struct.pack(">ii", 12, 2) + attr("_FillValue", 3, struct.pack(">h", -999), 1) + attr("scale_factor", 6, struct.pack(">d", 0.01), 1)

    def head(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">iii", 0, 10, 3) + b"".join(name(n) + struct.pack(">i", k) for n, k in (("time", nt), ("latitude", ny), ("longitude", nx)))
        out += struct.pack(">iiii", 0, 0, 11, 4)
        for (n, dims, kind, own), raw, at in zip((("time", [0], 6, None), ("latitude", [1], 5, None), ("longitude", [2], 5, None), ("sst", [0, 1, 2], 3, attrs)), data, begins):
            out += name(n) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + (own or struct.pack(">ii", 0, 0)) + struct.pack(">ii", kind, len(raw)) + struct.pack(">i" if version == 1 else ">q", at)
        return out

    size = len(head([0] * 4))
    return head([size + sum(map(len, data[:k])) for k in range(4)]) + b"".join(data)


@pytest.mark.parametrize("version", [1, 2])
def test_netcdf(spark, tmp_path, version):
    values = np.array([[[1500, -999], [2000, 9000]], [[1, 2], [3, 4]]])
    raw = netcdf(values, [20.0, 19.0], [120.0, 121.0], [43200, 86400 + 43200], version)
    (tmp_path / "a.nc").write_bytes(raw)
    got = {(r.day.isoformat(), r.lat, r.lon): r.value for r in netcdf3.read_grids(spark, str(tmp_path), "sst").collect()}
    assert len(got) == 8 and got["1970-01-01", 20.0, 120.0] == 15.0 and got["1970-01-01", 20.0, 121.0] is None and got["1970-01-01", 19.0, 121.0] is None
    assert got["1970-01-02", 19.0, 121.0] == pytest.approx(0.04)
    for bad in (b"\x89HDF\r\n", b"nope", raw[:-4]):
        with pytest.raises(ValueError):
            netcdf3.grid_rows(bad, "sst")


def test_profiles_csv(spark, tmp_path):
    text = "﻿lon,lat,pressure(db),temp_avg(deg.C),time_period\r\n120.0,20.0,10,25.5,13\r\n120.0,20.0,11,25.5,13\r\n120.0,20.0,20,NaN,13\r\n999,20,10,1,13\r\n120.0,20.0,10,1,99\r\n"
    (tmp_path / "a.csv").write_text(text, encoding="utf-8", newline="")
    rows = profiles_csv.read_profiles(spark, str(tmp_path / "a.csv"), [0.0, 10.0, 20.0], [0, 13]).orderBy("p").collect()
    assert [(r.period, r.j, r.i, r.p, r.t) for r in rows] == [(13, 8, 16, 10.0, 25.5), (13, 8, 16, 20.0, None)]


def test_streamed_windows(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    once = spark.read.parquet(src)
    once.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(once.schema).parquet(str(tmp_path / "in"))
    q = windows.windowed_mean(stream, ["event_type"], "ts", "value").writeStream.outputMode("complete").format("memory").queryName("w5").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w5").groupBy().sum("n").first()[0] == once.where("value is not null").count()
