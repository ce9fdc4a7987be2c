"""Rounds of candidates: none is lost between a join by key and the pairs of a key, and a group costs about its members."""

import random

import numpy as np
from pyspark.sql import functions as F

from strataline.llm import nearcopies


def test_pairs_that_a_small_unlike_text_hides(spark):
    # under the shared shingles the smallest set is too small to be like the others, which are alike
    rng = random.Random(8)
    texts = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(200)]
        texts.append(" ".join(base[:40]))
        for _ in range(6):
            words = base.copy()
            words[rng.randrange(200)] = f"new{rng.randrange(10**9)}"
            texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "sid long, text string").repartition(5)
    none = spark.createDataFrame([], "a long, b long")
    got = {r.node: r.component for r in nearcopies.similar_components(df, none).collect()}
    assert got == {7 * g + k: 7 * g + 1 for g in range(60) for k in range(2, 7)}


def test_all_pairs_of_a_key_meet_after_joins_by_it(spark, tmp_path):
    ids = spark.range(2000).repartition(8)
    ids.select((F.col("id") % 50).alias("key"), F.lit(10).alias("n"), F.lit(0).alias("pos"), F.col("id").alias("sid")).write.parquet(f"{tmp_path}/met")
    ids.select(F.col("id").alias("sid"), F.expr("cast(repeat('a', 32) as binary)").alias("sketch")).write.parquet(f"{tmp_path}/sets")
    ids.where("id >= 1950").select(F.col("id").alias("node"), (F.col("id") - 1950).alias("component")).write.parquet(f"{tmp_path}/tied")
    met, sets, tied = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("met", "sets", "tied"))
    # as over tables too large to be broadcast by their files' size, of which some are small when they have been read
    sizes = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        got = {(r.a, r.b) for r in nearcopies._tried(met, tied, sets, best=False).collect()}
        best = {(r.a, r.b) for r in nearcopies._tried(met, tied, sets, best=True).collect()}
    finally:
        for k in sizes:
            spark.conf.unset(k)
    assert got == {(a, b) for a in range(2000) for b in range(a + 50, 2000, 50)} - {(k, 1950 + k) for k in range(50)}
    assert best < got and {x for p in best for x in p} == set(range(2000)) and len(best) <= 2 * 2000


def test_a_group_around_one_text_costs_its_members(spark, monkeypatch):
    # copies of one text, each edited elsewhere, and a shorter one that is like few of them
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for _ in range(200):
        words = base.copy()
        for at in rng.sample(range(5, 145), 3):
            words[at] = f"new{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    texts.append(" ".join([f"new{i}" for i in range(6)] + base[6:140]))
    counted = []
    thinned = nearcopies._thinned

    def counting(pairs, sets, sketch):
        out = thinned(pairs, sets, sketch)
        counted.append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "_thinned", counting)
    df = spark.createDataFrame(list(enumerate(texts)), "sid long, text string").repartition(3)
    none = spark.createDataFrame([], "a long, b long")
    got = nearcopies.similar_components(df, none).collect()
    assert {r.node for r in got} == set(range(1, 202)) and sum(counted) < 5 * len(texts)


def test_a_line_that_many_long_unlike_texts_hold_pairs_few(spark):
    # too long for the narrow sketch to tell them apart; two are alike
    rng = random.Random(4)
    line = " ".join(f"line{i}" for i in range(40))
    texts = [f"{line} " + " ".join(f"t{k}w{i}" for i in range(900)) for k in range(160)]
    words = texts[7].split()
    words[rng.randrange(100, 900)] = "new"
    texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "sid long, text string").repartition(4)
    tried = []
    plain = nearcopies._tried

    def counting(*args, **how):
        out = plain(*args, **how)
        tried.append(out.distinct().count())
        return out

    nearcopies._tried = counting
    try:
        got = {r.node: r.component for r in nearcopies.similar_components(df, spark.createDataFrame([], "a long, b long")).collect()}
    finally:
        nearcopies._tried = plain
    assert got == {160: 7} and sum(tried) < 100


def test_rare_shingles_first():
    own, key = np.array([2, 3, 5, 8, 9], np.uint64), np.array([3, 4, 8], np.uint64)
    assert nearcopies.ordered(own, key, np.array([7, 9, 4])).tolist() == [2, 5, 9, 8, 3]
    assert nearcopies.ordered(own, key[:0], np.zeros(0, np.int64)).tolist() == own.tolist()


def test_common_shingles_are_the_most_common(spark, monkeypatch):
    texts = ["a b c d e f"] * 5 + ["a b c d e"] * 4 + ["f g h i j"] * 3 + ["once only"]
    df = spark.createDataFrame(list(enumerate(texts)), "sid long, text string")
    names = {x: int(nearcopies.shingles(x.encode())[0]) for x in ("a b c d e", "b c d e f", "f g h i j")}
    want = {names["a b c d e"]: 9, names["b c d e f"]: 5, names["f g h i j"]: 3}
    monkeypatch.setattr(nearcopies, "COUNTED", 1)
    for most, least in ((3, 3), (2, 5), (1, 9), (0, 10)):
        monkeypatch.setattr(nearcopies, "COMMON", most)
        key, many = nearcopies._common(df)
        assert list(key) == sorted(key) and dict(zip(key.tolist(), many.tolist())) == {k: v for k, v in want.items() if v >= least}
