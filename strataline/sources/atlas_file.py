"""The binary atlas: one file of a lattice's profiles, read plane by plane.

The file holds a mark, a version, the length of a header in JSON, the header, and then for each variable of its two kinds
16-bit planes by period and level, each of them rows of nodes from south to north. Reading makes a partition of each
variable and period and opens the file at that place; conditions on variable, period and level leave out planes.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: Fixed values of the format.
MAGIC, VERSION, NODATA = b"TWHY", 1, -32768
SCHEMA = "variable string, period int, level double, j int, i int, lon double, lat double, value double"


_COMPARE = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, IsNotNull: lambda x, v: True}


@dataclass
class Layout:
    """What the header says, and where each plane begins."""

    lon0: float
    lat0: float
    step: float
    nlon: int
    nlat: int
    periods: list[int]
    #: by kind: (variable, scale) and levels
    kinds: list[tuple[list[tuple[str, float]], list[float]]]
    begin: int = 0

    @property
    def plane(self) -> int:
        return 2 * self.nlon * self.nlat

    def variables(self) -> Iterator[tuple[str, float, list[float], int]]:
        """Every variable with its scale, levels and the place of its first plane."""
        at = self.begin
        for names, levels in self.kinds:
            for name, scale in names:
                yield name, scale, levels, at
                at += self.plane * len(levels) * len(self.periods)

    def header(self) -> bytes:
        (c, clev), (a, alev) = self.kinds
        text = json.dumps({"ver": VERSION, "lon0": self.lon0, "lat0": self.lat0, "d": self.step, "nlon": self.nlon, "nlat": self.nlat, "tps": self.periods, "clev": clev, "alev": alev, "cvars": c, "avars": a, "nodata": NODATA}).encode()
        return MAGIC + struct.pack("<II", VERSION, len(text)) + text


def _open(path: str):
    where, name = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    return where.open_input_file(name)


def read_layout(path: str) -> Layout:
    """The header alone; a file with another mark, or one that ends too early, is an error."""
    with _open(path) as f:
        head = f.read(12)
        if head[:4] != MAGIC or len(head) < 12:
            raise ValueError(f"{path} isn't a binary atlas")
        version, n = struct.unpack("<II", head[4:])
        if version != VERSION:
            raise ValueError(f"{path} has version {version}, not {VERSION}")
        text = f.read(n)
        if len(text) < n:
            raise ValueError(f"{path} ends within its header")
        h = json.loads(text)
        out = Layout(h["lon0"], h["lat0"], h["d"], h["nlon"], h["nlat"], h["tps"], [([(x, s) for x, s in h["cvars"]], h["clev"]), ([(x, s) for x, s in h["avars"]], h["alev"])], 12 + n)
        ends = [at + out.plane * len(levels) * len(out.periods) for _, _, levels, at in out.variables()]
        if ends and f.size() < ends[-1]:
            raise ValueError(f"{path} ends before its last plane")
        return out


def plane_rows(raw: bytes, layout: Layout, variable: str, scale: float, period: int, level: float) -> pa.RecordBatch:
    x = np.frombuffer(raw, "<i2")
    j, i = np.divmod(np.arange(len(x)), layout.nlon)
    cols = [pa.array([variable] * len(x)), pa.array(np.full(len(x), period, np.int32)), pa.array(np.full(len(x), float(level))), pa.array(j.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(layout.lon0 + layout.step * i), pa.array(layout.lat0 + layout.step * j), pa.array(x / scale, mask=x == NODATA)]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class Planes(InputPartition):
    variable: str
    scale: float
    period: int
    places: list[tuple[float, int]] = field(default_factory=list)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = getattr(f, "attribute", ("",))[-1]
            if type(f) in _COMPARE and column in ("variable", "period", "level"):
                self.wanted.append((column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def _takes(self, **row) -> bool:
        return all(_COMPARE[kind](row[c], v) for c, kind, v in self.wanted)

    def partitions(self) -> list[Planes]:
        layout = read_layout(self.path)
        out = []
        for name, scale, levels, begin in layout.variables():
            for p, period in enumerate(layout.periods):
                places = [(level, begin + layout.plane * (p * len(levels) + k)) for k, level in enumerate(levels) if self._takes(variable=name, period=period, level=level)]
                if places:
                    out.append(Planes(name, scale, period, places))
        return out or [Planes("", 1.0, 0)]

    def read(self, partition: Planes) -> Iterator[pa.RecordBatch]:
        layout = read_layout(self.path)
        with _open(self.path) as f:
            for level, at in partition.places:
                f.seek(at)
                yield plane_rows(f.read(layout.plane), layout, partition.variable, partition.scale, partition.period, level)


class AtlasFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "atlas_file"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_atlas(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA of a file that all executors see; null where the file has no value."""
    spark.dataSource.register(AtlasFile)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("atlas_file").option("path", path).load()


def write_atlas(df: DataFrame, path: str, layout: Layout) -> None:
    """Writes rows of variable, period, level, j, i and value as one file; what isn't there has no value.

    Values are rounded to the variable's scale, halves away from zero; those that 16 bits can't hold are cut off. Planes
    are packed by tasks and come here one after another, a partition at a time: a file's size is that of its lattice.
    Rows that repeat a place give the largest value; rows off the lattice are left out.
    """
    spark = df.sparkSession
    order = [(name, float(scale), period, float(level)) for name, scale, levels, _ in layout.variables() for period in layout.periods for level in levels]
    places = F.broadcast(spark.createDataFrame([(n, *x) for n, x in enumerate(order)], "place int, variable string, scale double, period int, level double"))  # a row for each plane
    inside = F.col("j").between(0, layout.nlat - 1) & F.col("i").between(0, layout.nlon - 1)
    value = F.greatest(F.lit(-32767), F.least(F.lit(32767), F.round(F.col("value") * F.col("scale")))).cast("int")
    node = (F.col("j") * layout.nlon + F.col("i")).cast("int")
    rows = df.where(inside & F.col("value").isNotNull() & ~F.isnan("value")).join(places, ["variable", "period", "level"]).select("place", node.alias("node"), value.alias("v"))
    cells = layout.nlat * layout.nlon

    def pack(group: pa.Table) -> pa.Table:
        plane = np.full(cells, NODATA, "<i2")
        np.maximum.at(plane, group["node"].to_numpy(), group["v"].to_numpy().astype(np.int16))
        return pa.table([group["place"][:1], pa.array([plane.tobytes()], pa.binary())], names=["place", "plane"])

    packed = rows.groupBy("place", "node").agg(F.max("v").alias("v")).groupBy("place").applyInArrow(pack, "place int, plane binary").orderBy("place")
    where, name = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    with where.open_output_stream(name) as out:
        out.write(layout.header())
        at, nothing = 0, np.full(cells, NODATA, "<i2").tobytes()
        for r in packed.toLocalIterator():
            for _ in range(at, r.place):
                out.write(nothing)
            out.write(bytes(r.plane))
            at = r.place + 1
        for _ in range(at, len(order)):
            out.write(nothing)


def valid_shares(df: DataFrame) -> DataFrame:
    """variable, nodes, valid: how many places each variable has and the share of them with a value."""
    return df.groupBy("variable").agg(F.count("*").alias("nodes"), F.avg(F.col("value").isNotNull().cast("int")).alias("valid"))
