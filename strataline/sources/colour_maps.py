"""Maps drawn in colours, read back as numbers: their colour bar, lines of degrees, and the bar's colour next to each pixel's.

Spark decodes the images. A task finds one image's bar and lines and counts its pixels by cell and colour of the bar, so
that what leaves it are counts; medians and means of cells are Spark's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Layout:
    """Where a kind of map has its parts, in pixels. A dark line of a degree lies within slack of its place."""

    bar_column: int = 115
    bar_band: tuple[int, int] = (104, 126)
    bar_rows: tuple[int, int] = (200, 900)
    low: float = -2.0
    high: float = 30.0
    #: A bar of more pixels than this ends at tall_high instead.
    tall: int = 515
    tall_high: float = 35.0
    lons: dict[float, int] = field(default_factory=lambda: {x: int(75 + (x - 116) * 100) for x in (118.0, 120.0, 122.0, 124.0, 126.0)})
    lats: dict[float, int] = field(default_factory=lambda: {y: int(48 + (32 - y) * 100) for y in (30.0, 28.0, 26.0, 24.0, 22.0, 20.0)})
    plot_rows: tuple[int, int] = (60, 1430)
    plot_columns: tuple[int, int] = (90, 1260)
    slack: int = 8
    #: A pixel further from every colour of the bar, or less saturated, holds no value.
    near: float = 18.0
    saturation: int = 100


@dataclass(frozen=True)
class Grid:
    """Cells of the result: cell (j, i) begins at lat0 + j * step, lon0 + i * step."""

    lat0: float = 22.0
    lon0: float = 119.0
    rows: int = 120
    columns: int = 120
    step: float = 0.05


def _bar(pixels: np.ndarray, at: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Colours of the bar, row by row, and their values; two rows at each end are left out."""
    spread = np.ptp(pixels[:, at.bar_column].astype(np.int16), axis=1) > 40
    found = np.flatnonzero(spread[slice(*at.bar_rows)])
    if not len(found):
        raise ValueError("no colour bar")
    first = int(found[0]) + at.bar_rows[0]
    after = np.flatnonzero(~spread[first:])
    last = first + (int(after[0]) if len(after) else len(spread) - first) - 1
    if last - first < 8:
        raise ValueError("no colour bar")
    rows = np.arange(first + 2, last)
    high = at.tall_high if last - first + 1 > at.tall else at.high
    return np.median(pixels[rows, slice(*at.bar_band)], axis=1), high - (rows - first) / (last - first) * (high - at.low)


def _degrees(dark: np.ndarray, places: dict[float, int], slack: int) -> np.ndarray:
    """Slope and intercept of pixel over degree through the darkest lines near their places."""
    near = {d: np.arange(max(p - slack, 0), min(p + slack + 1, len(dark))) for d, p in places.items()}
    if any(not len(w) or not dark[w].any() for w in near.values()):
        raise ValueError("a line of degrees is missing")
    return np.polyfit(list(near), [w[np.argmax(dark[w])] for w in near.values()], 1)


def _nearest(colours: np.ndarray, bar: np.ndarray, at: Layout) -> np.ndarray:
    """Index of the bar's nearest colour (the first of equally near ones), -1 where none is near; each colour is looked up once."""
    packed, back = np.unique(colours.astype(np.int64) @ np.array([65536, 256, 1]), return_inverse=True)
    each = np.stack([packed >> 16, packed >> 8 & 255, packed & 255], axis=1)
    index, least = np.empty(len(each), np.int64), np.empty(len(each))
    for s in range(0, len(each), 4096):
        d = ((each[s : s + 4096, None].astype(float) - bar) ** 2).sum(axis=2)
        index[s : s + 4096], least[s : s + 4096] = d.argmin(axis=1), d.min(axis=1)
    return np.where((least < at.near**2) & (np.ptp(each, axis=1) > at.saturation), index, -1)[back]


def _counted(pixels: np.ndarray, at: Layout, grid: Grid) -> tuple[np.ndarray, ...]:
    """j, i, value (NaN: not read) and number of pixels."""
    bar, values = _bar(pixels, at)
    dark = pixels.sum(axis=2, dtype=np.int32) < 150
    x = _degrees(dark[slice(*at.plot_rows)].sum(axis=0), at.lons, at.slack)
    y = _degrees(dark[:, slice(*at.plot_columns)].sum(axis=1), at.lats, at.slack)
    i = np.floor(((np.arange(pixels.shape[1]) - x[1]) / x[0] - grid.lon0) / grid.step).astype(int)
    j = np.floor(((np.arange(pixels.shape[0]) - y[1]) / y[0] - grid.lat0) / grid.step).astype(int)
    cols, rows = np.flatnonzero((i >= 0) & (i < grid.columns)), np.flatnonzero((j >= 0) & (j < grid.rows))
    colour = _nearest(pixels[np.ix_(rows, cols)].reshape(-1, 3), bar, at)
    cell = (j[rows][:, None] * grid.columns + i[cols]).ravel()
    key, n = np.unique(cell * (len(bar) + 1) + colour + 1, return_counts=True)
    cell, colour = np.divmod(key, len(bar) + 1)
    return cell // grid.columns, cell % grid.columns, np.where(colour > 0, values[colour - 1], np.nan), n


def _pixels(image: dict) -> np.ndarray:
    """An image's rows of red, green and blue; Spark gives blue first."""
    n = image["nChannels"]
    if image["height"] <= 0 or n not in (1, 3, 4):
        raise ValueError("not an image")
    x = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], n)
    return np.repeat(x, 3, axis=2) if n == 1 else x[:, :, 2::-1]


def _images(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("image").option("pathGlobFilter", glob).load(path).select("image.*")


def day_of(name: Column) -> Column:
    """Day in a file's name: after an underscore and before six digits of time, else the first year, month and day; null without."""
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), "%20", " ")
    stamp, plain = r"_(20\d\d)(\d\d)(\d\d)\d{6}", r"(20\d\d)-?(\d\d)-?\s?(\d\d)"
    text = F.when(base.rlike(stamp), F.concat_ws("-", *[F.regexp_extract(base, stamp, k) for k in (1, 2, 3)])).when(base.rlike(plain), F.concat_ws("-", *[F.regexp_extract(base, plain, k) for k in (1, 2, 3)]))
    return text.try_cast("date")


def read_colour_maps(spark: SparkSession, path: str, layout: Layout = Layout(), grid: Grid = Grid(), glob: str = "*.png") -> DataFrame:
    """origin, day, j, i, value (null: no colour of the bar), n pixels, problem.

    An image without a bar or lines, or that can't be decoded, gives one row with its problem and nothing else. An image
    must fit into a task.
    """

    def run(batches):
        for batch in batches:
            for image in batch.to_pylist():
                try:
                    j, i, value, n = _counted(_pixels(image), layout, grid)
                    columns = [pa.array(j, pa.int32()), pa.array(i, pa.int32()), pa.array(value, mask=np.isnan(value)), pa.array(n, pa.int64()), pa.nulls(len(n), pa.string())]
                except (ValueError, IndexError) as e:
                    columns = [pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.int64()), pa.array([str(e)])]
                yield pa.RecordBatch.from_arrays([pa.array([image["origin"]] * len(columns[0]), pa.string()), *columns], names=["origin", "j", "i", "value", "n", "problem"])

    rows = _images(spark, path, glob).mapInArrow(run, "origin string, j int, i int, value double, n long, problem string")
    return rows.select("origin", day_of(F.col("origin")).alias("day"), "j", "i", "value", "n", "problem")


def cell_values(counts: DataFrame, keys: list[str], value: str, n: str, within: float = 1.0, least: int = 3, share: float = 0.3) -> DataFrame:
    """keys, value, read: the mean of the counted values within a distance of their median, and the share that was read.

    Null without least read values and that share of all. One shuffle by keys serves median and mean.
    """
    both = counts.select(*keys, F.col(value).alias("_x"), F.col(n).alias("_n")).select("*", F.percentile("_x", F.lit(0.5), F.col("_n")).over(Window.partitionBy(*keys)).alias("_mid"))
    known, close = F.col("_x").isNotNull(), F.abs(F.col("_x") - F.col("_mid")) < within
    total = lambda when, x: F.sum(F.when(when, x))
    out = both.groupBy(*keys).agg(
        F.sum("_n").alias("_all"), F.coalesce(total(known, F.col("_n")), F.lit(0)).alias("_known"), F.max("_mid").alias("_mid"),
        total(close, F.col("_x") * F.col("_n")).alias("_sum"), total(close, F.col("_n")).alias("_near"),
    )
    enough = F.col("_known") >= F.greatest(F.lit(float(least)), F.col("_all") * share)
    return out.select(*keys, F.when(enough, F.coalesce(F.col("_sum") / F.col("_near"), "_mid")).alias(value), F.try_divide(F.col("_known"), F.col("_all")).alias("read"))


def read_mask(spark: SparkSession, path: str, above: int = 127, glob: str = "*.png") -> DataFrame:
    """origin, y, x (from 0, at the image's top left), land: whether the first channel of a mask's pixel exceeds a number."""

    def run(batches):
        for batch in batches:
            for image in batch.to_pylist():
                red = _pixels(image)[:, :, 0]
                y, x = np.indices(red.shape, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([image["origin"]] * red.size, pa.string()), pa.array(y.ravel()), pa.array(x.ravel()), pa.array((red > above).ravel())], names=["origin", "y", "x", "land"])

    return _images(spark, path, glob).mapInArrow(run, "origin string, y int, x int, land boolean")
