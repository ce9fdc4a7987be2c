"""Warm spells of a stream against those of the whole table, in one batch and in many, with late days."""

import datetime as dt
import random

import pytest

from strataline.operators import events
from strataline.streaming import spells as sp

DAY0 = dt.datetime(2001, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "k string, day timestamp, v double, thr double"


def by_hand(hot, shortest, gap):
    runs = []
    for d in sorted(hot):
        if runs and (d - runs[-1][1]).days == 1:
            runs[-1][1] = d
        else:
            runs.append([d, d])
    out = []
    for a, z in runs:
        if (z - a).days + 1 >= shortest:
            if out and (a - out[-1][1]).days - 1 <= gap:
                out[-1][1] = z
            else:
                out.append([a, z])
    return [tuple(x) for x in out]


def test_closing_in_any_steps():
    for seed in range(300):
        r = random.Random(seed)
        day = lambda n: dt.date(2001, 1, 1) + sp.DAY * n
        hot = [day(n) for n in range(60) if r.random() < 0.75]
        got, keep, final = [], [], 0
        while final < 80:
            step = r.randrange(1, 9)
            keep = sorted({*keep, *(d for d in hot if day(final) <= d < day(final + step))})
            final += step
            found, keep = sp.closed_spells(keep, day(final - 1), 3, 2)
            got += found
        assert got == by_hand(hot, 3, 2) and keep == []


@pytest.mark.parametrize("batches", [1, 6])
def test_streamed_spells(spark, tmp_path, batches):
    r = random.Random(7)
    rows = [(k, DAY0 + sp.DAY * n, float(r.random() < 0.8), 0.5) for k in ("a", "b") for n in range(60)]
    # a last cold stretch with one far hot day, which closes what came before
    rows += [(k, DAY0 + sp.DAY * 90, 1.0, 0.5) for k in ("a", "b", "c")]
    chunks = [rows[:] for _ in range(1)] if batches == 1 else [[x for x in rows if n * 16 - (r.random() < 0.2) * 1 <= (x[1] - DAY0).days < (n + 1) * 16] for n in range(batches)]
    for n, c in enumerate(chunks):
        spark.createDataFrame(c, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{n}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = sp.streamed_spells(stream, "k", "day", "v", 3, 2, 3).writeStream.outputMode("append").format("memory").queryName(f"spells{batches}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(150)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    whole = spark.createDataFrame(rows, SCHEMA).selectExpr("k", "cast(day AS date) AS day", "v", "thr")
    want = {(x.k, x.start, x.stop) for x in events.spells(whole, ["k"], "day", "v", 3, 2).collect()}
    assert {tuple(x) for x in spark.table(f"spells{batches}").select("k", "start", "stop").collect()} == want
