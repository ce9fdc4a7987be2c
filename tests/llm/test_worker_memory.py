"""What the Python workers of the pipeline's stages hold at once."""

import random
import tracemalloc

from pyspark.sql import functions as F

from strataline.llm import toxicity as tox
from strataline.llm.learn import labelled_rows


def most_held(f):
    """MB that f has beyond what was there before, and what it returns."""
    tracemalloc.start()
    try:
        out = f()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_kernels_of_many_words_are_summed_a_few_at_a_time(monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdef", k=16)) for _ in range(2000)]
    kernel = tox.Kernel(words[:60])
    held, got = most_held(lambda: kernel.of(words))
    assert held < 100
    monkeypatch.setattr(tox, "WORDS_AT_ONCE", 7)
    assert (kernel.of(words) == got).all()


def test_sample_needs_no_second_kind_of_python_worker(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    sample = labelled_rows(docs, labels, "toxic", F.lit(True), 20, 1000)
    assert "ExistingRDD" not in sample._jdf.queryExecution().executedPlan().toString()
    got = sample.orderBy("place").collect()
    assert [r.place for r in got] == list(range(20)) and all(int(r.text.split()[1]) % 2 == r.y for r in got)
