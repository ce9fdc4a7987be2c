"""A daily field behind a server that is asked for windows of days and a box: a Spark data source, a partition for each window.

Conditions on day, lat and lon become part of the requests. A request is repeated a bounded number of times; a window
that fails is halved and asked for again until few days are left, which are then recorded as failed, while all other days
come in. A folder of daily files, YYYY-MM-DD.nc, that all executors see can stand for the server.
"""

from __future__ import annotations

import datetime as dt
import os
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .netcdf3 import grid_arrays

#: A row is a value of a day and cell, or the record of days (day to until) that failed: then error says why.
SCHEMA = "window date, day date, until date, lat double, lon double, value double, error string"
DAY = dt.timedelta(days=1)
_COMPARE = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


@dataclass
class Request:
    """What is asked for: the days and box may be narrowed by filters; tests are conditions that rows still have to meet."""

    base: str
    variable: str
    start: dt.date
    end: dt.date
    days: int = 30
    least_days: int = 4
    retries: int = 2
    pause: float = 1.0
    timeout: float = 100.0
    give_up: int = 8
    level: float | None = None
    stride: int = 1
    quantum: float | None = 0.01
    box: dict[str, list[float]] = field(default_factory=lambda: {"lat": [-90.0, 90.0], "lon": [-180.0, 360.0]})
    tests: list[tuple[type, str, float]] = field(default_factory=list)
    done: frozenset[dt.date] = frozenset()

    @staticmethod
    def of(options: dict[str, str]) -> Request:
        o = {k.lower(): v for k, v in options.items()}
        start, end = (dt.date.fromisoformat(o[k]) if k in o else None for k in ("start", "end"))
        if start is None or end is None:
            first, last = extent(o["base"], float(o.get("timeout", 45)))
            start, end = max(start or first, first), min(end or last, last)
        r = Request(o["base"], o["variable"], start, end)
        for name, kind in (("days", int), ("least_days", int), ("retries", int), ("give_up", int), ("stride", int), ("pause", float), ("timeout", float), ("level", float), ("quantum", float)):
            if name in o:
                setattr(r, name, kind(o[name]))
        for axis in r.box:
            r.box[axis] = [float(o.get(f"{axis}0", r.box[axis][0])), float(o.get(f"{axis}1", r.box[axis][1]))]
        r.done = frozenset(map(dt.date.fromisoformat, filter(None, o.get("done", "").split(","))))
        return r

    def narrow(self, f: Filter) -> bool:
        """Takes a filter over if it can be part of the requests."""
        kind, column = type(f), getattr(f, "attribute", ("",))[-1]
        if kind is IsNotNull and column in ("day", "lat", "lon"):
            return True  # values have all three, and records of failures pass
        if kind not in _COMPARE or column not in ("day", "lat", "lon") or f.value is None:
            return False
        if column == "day":
            at = f.value.date() if isinstance(f.value, dt.datetime) else f.value
            if kind in (EqualTo, GreaterThan, GreaterThanOrEqual):
                self.start = max(self.start, at + DAY * (kind is GreaterThan))
            if kind in (EqualTo, LessThan, LessThanOrEqual):
                self.end = min(self.end, at - DAY * (kind is LessThan))
            return True
        span, at = self.box[column], float(f.value)
        if kind in (EqualTo, GreaterThan, GreaterThanOrEqual):
            span[0] = max(span[0], at)
        if kind in (EqualTo, LessThan, LessThanOrEqual):
            span[1] = min(span[1], at)
        self.tests.append((kind, column, at))
        return True

    def windows(self) -> list[tuple[dt.date, dt.date]]:
        out, a = [], self.start
        while a <= self.end:
            out.append((a, min(a + DAY * (self.days - 1), self.end)))
            a += DAY * self.days
        return [w for w in out if w[0] not in self.done]

    def url(self, a: dt.date, b: dt.date) -> str:
        span = lambda lo, hi: f"[({lo:g}):{self.stride}:({hi:g})]"
        level = "" if self.level is None else f"[({self.level:g})]"
        return f"{self.base}.nc?{self.variable}" + urllib.parse.quote(f"[({a}T00:00:00Z):1:({b}T23:59:59Z)]{level}{span(*self.box['lat'])}{span(*self.box['lon'])}", safe="():,")


def _open(url: str, timeout: float) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as f:
        return f.read()


def extent(base: str, timeout: float = 45.0) -> tuple[dt.date, dt.date]:
    """First and last day that there is: of a folder's files, or what a server's attributes (.das) say of time."""
    if os.path.isdir(base):
        days = sorted(n[:10] for n in os.listdir(base) if re.fullmatch(r"\d{4}-\d\d-\d\d\.nc", n))
        if not days:
            raise ValueError(f"no daily files in {base}")
        return dt.date.fromisoformat(days[0]), dt.date.fromisoformat(days[-1])
    text = _open(f"{base}.das", timeout).decode("utf-8", "replace")
    m = re.search(r"time\s*\{[^}]*actual_range\s+([-+.\deE]+)\s*,\s*([-+.\deE]+)", text)
    if not m:
        raise ValueError(f"{base} doesn't say which time it covers")
    return tuple(dt.date(1970, 1, 1) + DAY * int(float(x) // 86400) for x in m.groups())


def fetch(r: Request, a: dt.date, b: dt.date) -> list[bytes]:
    """The files of a window of days: one from a server, one a day from a folder."""
    if os.path.isdir(r.base):
        out = []
        for k in range((b - a).days + 1):
            with open(os.path.join(r.base, f"{a + DAY * k}.nc"), "rb") as f:
                out.append(f.read())
        return out
    return [_open(r.url(a, b), r.timeout)]


def asked(r: Request, a: dt.date, b: dt.date, get: Callable = fetch) -> tuple[np.ndarray, ...]:
    """Days, lat, lon and values of a window, inside the box; tried again with growing pauses before the error goes out."""
    for k in range(r.retries + 1):
        try:
            parts = [grid_arrays(raw, r.variable, quantum=r.quantum) for raw in get(r, a, b)]
            break
        except (OSError, ValueError, KeyError, StopIteration):
            if k == r.retries:
                raise
            time.sleep(r.pause * (k + 1))
    day, lat, lon, x = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0),) * 4
    days = (np.array([a, b], "datetime64[D]")).astype(np.int64)
    keep = (day >= days[0]) & (day <= days[1])
    for axis, v in (("lat", lat), ("lon", lon)):
        keep &= (v >= r.box[axis][0]) & (v <= r.box[axis][1])
        if r.stride > 1 and os.path.isdir(r.base):
            keep &= np.isin(v, np.unique(v[(v >= r.box[axis][0]) & (v <= r.box[axis][1])])[:: r.stride])
    for kind, axis, at in r.tests:
        keep &= _COMPARE[kind]({"lat": lat, "lon": lon}[axis], at)
    return day[keep], lat[keep], lon[keep], x[keep]


def window_rows(r: Request, a: dt.date, b: dt.date, get: Callable = fetch) -> Iterator[pa.RecordBatch]:
    """Rows of a window; where a request fails, of its halves. After give_up failures in a row the rest isn't asked for."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    open_, failed = [(a, b)], 0
    while open_:
        x, y = open_.pop()
        try:
            if failed >= r.give_up:
                raise OSError(f"not asked for after {failed} failures")
            day, lat, lon, v = asked(r, x, y, get)
        except (OSError, ValueError, KeyError, StopIteration) as e:
            n = (y - x).days + 1
            if n > r.least_days and failed < r.give_up:
                mid = x + DAY * (n // 2 - 1)
                open_ += [(mid + DAY, y), (x, mid)]
                continue
            failed += 1
            row = [[a], [x], [y], [None], [None], [None], [f"{type(e).__name__}: {e}"[:500]]]
            kinds = [pa.date32()] * 3 + [pa.float64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=names)
            continue
        failed = 0
        n = len(day)
        cols = [pa.array([a] * n, pa.date32()), pa.array(day.astype(np.int32), pa.int32()).cast(pa.date32()), pa.nulls(n, pa.date32()), pa.array(lat, pa.float64()), pa.array(lon, pa.float64()), pa.array(v, pa.float64(), mask=np.isnan(v)), pa.nulls(n, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=names)


@dataclass
class Window(InputPartition):
    a: dt.date
    b: dt.date


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.request = Request.of(options)

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if not self.request.narrow(f):
                yield f

    def partitions(self) -> list[Window]:
        return [Window(a, b) for a, b in self.request.windows()]

    def read(self, partition: Window | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from window_rows(self.request, partition.a, partition.b)


class GridWindows(DataSource):
    """Options: base and variable; start, end (else the server's extent); days, least_days, retries, pause, timeout, give_up,
    level, stride, quantum; lat0, lat1, lon0, lon1."""

    @classmethod
    def name(cls) -> str:
        return "grid_windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_windows(spark: SparkSession, **options) -> DataFrame:
    """Rows of SCHEMA; conditions on day, lat and lon reach the requests. Failure records pass conditions on lat and lon."""
    spark.dataSource.register(GridWindows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("grid_windows").options(**{k: str(v) for k, v in options.items()}).load()


def harvest(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reads all windows into Parquet under path, a folder for each, and returns them; what is whole there isn't asked for again.

    A window with failures is read and written again as one, so that running this twice changes nothing.
    """
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at):
        whole = spark.read.parquet(path).groupBy("window").agg(F.count("error").alias("failed")).where("failed = 0")
        options["done"] = ",".join(r.window.isoformat() for r in whole.select(F.col("window").cast("date").alias("window")).collect())  # a date for each window
    df = read_windows(spark, **options)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window").parquet(path)
    return spark.read.parquet(path)


def check_source(df: DataFrame) -> DataFrame:
    """A source's self-test: days, values that are there, their mean, and failed records."""
    return df.agg(F.count_distinct(F.when(F.col("error").isNull(), F.col("day"))).alias("days"), F.count("value").alias("values"), F.avg("value").alias("mean"), F.count("error").alias("failed"))
