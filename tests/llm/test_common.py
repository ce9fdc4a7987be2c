"""What the operators share."""

import pytest
from pyspark.sql import functions as F

from strataline.llm import common


def test_join_split_is_the_join(spark):
    rows = spark.range(400).select((F.when(F.col("id") < 150, 7).otherwise(F.col("id") % 40)).alias("k"), "id")
    keys = rows.groupBy("k").agg(F.count("*").alias("many")).where("many > 5 and k % 2 = 1")
    want = sorted(map(tuple, rows.join(keys, ["k"]).collect()))
    for share in (1, 3, 1000):
        assert sorted(map(tuple, common.join_split(rows, keys, ["k"], "many", 400, share).select("k", "id", "many").collect())) == want


def test_names_and_ids(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, `B b` int, _a int")
    assert common.fresh(df, "A", "c") == ["__A", "c"] and common.others(df, "b B", "x") == ["`a`", "`_a`"]
    assert df.select(common.whole_id(df, "a")).first()[0] == 1
    with pytest.raises(TypeError):
        common.whole_id(df.select(F.lit("x").alias("a")), "a")


def test_written_and_cut(spark):
    df = spark.range(10)
    t = common.written(df)
    assert t.count() == 10 and common.cut(df).count() == 10
    common.discard(t)
