"""Repeated query ids, texts with very many spans, and names that clash in the pipeline's stages."""

import os
import re
import sys

import pytest

from strataline.llm import nearcopies, pii, topk

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_query_ids_that_repeat(spark, scale):
    rows = [(50, [9.0, 1.0]), (50, [9.0, 1.0]), (50, [-3.0, 2.0]), (100, [1.0, 1.0])] + [(i, [float(i), 0.0]) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.vec_id % 50 == 0, scale=scale, query_block=2, cand_block=4).collect())
    want = []
    for n, (i, q) in enumerate(rows):
        if i % 50 == 0:
            best = sorted((-int(sum(int(scale * a) * int(scale * b) for a, b in zip(q, c))), j) for m, (j, c) in enumerate(rows) if m != n)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


def spans_of(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[a-z0-9.]+@[a-z]+\.[a-z]+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_very_many_spans(spark):
    parts = [f"é{'x' * (k % 70)} a{k}@b.co {k % 256}.2.3.4 " if k % 3 else f"\n{k}.1.1.9;" for k in range(12_000)]
    long = "".join(parts)
    df = spark.createDataFrame([(1, long), (1, long), (2, "é" * 3000 + " call (212) 555-0199, GB82 WEST 1234 5698 7654 32"), (3, None)], "doc_id long, text string")
    got = pii.pii_digest(df).collect()
    want = [s for s in spans_of(long) if s[0] == "email" or int(long[s[1] : s[2]].split(".")[0]) <= 255]
    for r in got:
        if r.doc_id == 1:
            assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        elif r.doc_id == 2:
            assert r.spans == "localphone:3006:3020,iban:3022:3049"
    masked = {r.doc_id: r.text for r in pii.mask_pii(df).collect()}
    out, at = [], 0
    for k, a, b in want:
        if a >= at:
            out.append(long[at:a] + f"<{k}>")
        at = max(at, b)
    assert masked[1] == "".join(out) + long[at:] and masked[2].endswith(" call <localphone>, <iban>") and masked[3] is None


def test_running_values(spark):
    from pyspark.sql import functions as F

    rows = [[], [5], list(range(1, 12)), [3, 9, 2, 9, 1] * 7]
    df = spark.createDataFrame([(r,) for r in rows], "v array<long>")
    zero = F.lit(0).cast("long")
    for r in df.select("v", pii._running(F.col("v"), pii._added, zero).alias("s"), pii._running(F.col("v"), lambda a, x: F.greatest(a, x), zero).alias("m")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))] and r.m == [max([0, *r.v[:i]]) for i in range(len(r.v))]


CLASH = "doc_id long, text string, lang string, source string, n_chars long, set_name_bytes int, Toxicity int, pii_text int, PII_pieces int, set_name int, row_at int, s int"


@pytest.mark.parametrize("stage", [f for n, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_with_clashing_names_and_no_rows(spark, stage):
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, 5, 6, 7) for i, t in enumerate(["some words of a text", "some words of a text", None, "", "other words, mail a@b.co here"])]
    df = spark.createDataFrame(rows, CLASH)
    out = stage(spark, df, DATA)
    assert out.columns == df.columns and {r.row_at for r in out.collect()} == {6}
    assert stage(spark, df.where("false"), DATA).count() == 0


def test_sets_beside_a_column_of_the_helpers_name(spark):
    df = spark.createDataFrame([("a b", 1), (None, 2)], "text string, x_bytes int")
    out = nearcopies.with_set(df, "text", "x")
    assert out.columns == ["text", "x_bytes", "x"] and out.count() == 2
