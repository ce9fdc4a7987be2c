"""Warm spells of a stream of days (an extension): the runs and merges of operators.events, found as days come in.

Each key's processor holds the days that may still change, in memory only those since the oldest spell that isn't final. A
spell is final, and goes out, once the watermark has passed the day after which no late day and no merge can change it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = dt.timedelta(days=1)


def closed_spells(hot: list[dt.date], final: dt.date, shortest: int, gap: int) -> tuple[list[tuple[dt.date, dt.date]], list[dt.date]]:
    """(spells that no day after final can change, hot days to keep) of sorted hot days; days up to final are settled."""
    runs: list[list[dt.date]] = []
    for d in hot:
        if runs and d - runs[-1][1] == DAY:
            runs[-1][1] = d
        else:
            runs.append([d, d])
    spells: list[list[dt.date]] = []
    keep = None
    for a, z in runs:
        # a run may still grow if it touches days that aren't settled
        if keep is None and z >= final:
            keep = a
        if keep is None and (z - a).days + 1 >= shortest:
            if spells and (a - spells[-1][1]).days - 1 <= gap:
                spells[-1][1] = z
            else:
                spells.append([a, z])
    if spells:
        a, z = spells[-1]
        # the next run may begin up to gap days after the last spell, on a day that is settled but open or one to come
        reach = z + DAY * (gap + 1)
        if reach > final or (keep is not None and keep <= reach):
            spells.pop()
            keep = a
    return [tuple(s) for s in spells], [d for d in hot if keep is not None and d >= keep]


class SpellProcessor(StatefulProcessor):
    def __init__(self, shortest: int, gap: int, late_days: int):
        self.shortest, self.gap, self.late = shortest, gap, late_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hot = handle.getMapState("hot", T.StructType([T.StructField("day", T.DateType())]), T.StructType([T.StructField("one", T.IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for d in part["day"]:
                self.hot.updateValue((d,), (1,))
        yield from self._out(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._out(key, timerValues.getCurrentWatermarkInMs())

    def _out(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        final = dt.datetime.fromtimestamp(watermark / 1000, dt.timezone.utc).date() - DAY
        hot = sorted(k[0] for k in self.hot.keys()) if self.hot.exists() else []
        found, keep = closed_spells(hot, final, self.shortest, self.gap)
        kept = set(keep)
        for d in hot:
            if d not in kept:
                self.hot.removeKey((d,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        # the next day on which a run can have ended for good
        ends = (d + DAY * (self.gap + 3) for d in keep if d + DAY not in kept)
        when = next((e for e in ends if e > final + DAY), None)
        if when is not None:
            self.handle.registerTimer(int(dt.datetime.combine(when, dt.time(), dt.timezone.utc).timestamp() * 1000))
        if found:
            yield pd.DataFrame({"key": [key[0]] * len(found), "start": [a for a, _ in found], "stop": [z for _, z in found]})

    def close(self) -> None:
        pass


def streamed_spells(stream: DataFrame, key: str, day: str, value: str, shortest: int = 5, gap: int = 2, late_days: int = 3) -> DataFrame:
    """key, start, stop of a stream of key, day (a timestamp of its beginning, UTC), value and thr; days may be late_days late.

    A day counts once however often it comes. Spells come out in append mode when they are final: when days later than
    late_days, the gap and a day have been seen.
    """
    hot = stream.where(F.col(value) > F.col("thr")).select(F.col(key).alias("key"), F.col(day).cast("date").alias("day"), F.col(day).cast("timestamp").alias("_ts"))
    every = hot.withWatermark("_ts", f"{late_days} days")
    schema = T.StructType([T.StructField("key", stream.schema[key].dataType), T.StructField("start", T.DateType()), T.StructField("stop", T.DateType())])
    out = every.groupBy("key").transformWithStateInPandas(SpellProcessor(shortest, gap, late_days), schema, "Append", "EventTime")
    return out.withColumnRenamed("key", key)
