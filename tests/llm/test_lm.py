"""Language-model scores against sums by hand: counts, explicit softmax, probabilities that sum to one, and odd tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from strataline.llm import lm
from strataline.llm import queries as q

DATA = "/root/testdata/sf0.001"


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), ""]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


ODD = [(None, None), (None, "Ä ÉÉ a b c"), (5001, ""), (5002, " \t\n"), (5003, "the " * 3000 + "x" * 300), (5003, "the " * 3000 + "x" * 300), (5004, "never-seen-before")]


def test_scores_by_hand(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()] + ODD
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n_tokens int, W string").repartition(3)
    train = df.where(~lm.held_out_rows("doc_id"))
    model, counts = lm.fit(train, words=20, buckets=8, most=60)
    got = sorted(lm.with_scores(df, model, counts).collect(), key=str)
    assert got[0].asDict().keys() == {"doc_id", "W", "n_tokens", "n_known", "base_score", "score"}

    c = Counter(w for i, t in rows if not held(i) for w in words_of(t))
    n, kinds = sum(c.values()), len(c)
    assert (model.corpus.n, model.corpus.kinds) == (n, kinds)
    own = {w.decode(): k for w, k in model.corpus.own.items()}
    cls = lambda w: own[w] if w in own else 1 + zlib.crc32(w.encode()[-2:]) % 8
    total, once = Counter(), Counter()
    for w, x in c.items():
        if w not in own:
            total[cls(w)] += x
            once[cls(w)] += x == 1
    sizes = np.array([sum(x for w, x in c.items() if cls(w) == k) for k in range(len(own) + 8)])
    assert (model.corpus.counts == sizes).all()
    net, share = model.net, np.log((sizes + 1) / (n + len(sizes)))

    def given(a, b):
        s = (net.second[a].astype(float) + net.first[b]) @ net.out.T.astype(float) + net.bias + share
        return s - math.log(np.exp(s - s.max()).sum()) - s.max()

    def inside(w):
        k = cls(w)
        if w in own:
            return 1.0
        u = (once[k] + 1) / (total[k] + 2) if total[k] else 1.0
        return (1 - u) * c[w] / total[k] if w in c else u

    # all known words and one unknown word of each bucket
    everything = [*c, *(next(x for x in map("zq{}".format, range(9999)) if cls(x) == k and x not in c) for k in range(1, 9))]
    p = given(3, 5)
    assert math.isclose(sum(math.exp(p[cls(w)]) * inside(w) for w in everything), 1, rel_tol=1e-6)

    def by_hand(i, t):
        ws = words_of(t)
        before = [0, 0, *map(cls, ws)]
        score = sum(given(before[k], before[k + 1])[cls(w)] / math.log(10) + math.log10(inside(w)) for k, w in enumerate(ws))
        return i, len(ws), sum(w in c for w in ws), sum(math.log10((c[w] + 1) / (n + kinds + 1)) for w in ws), score

    want = sorted((by_hand(i, t) for i, t in rows[-12:]), key=str)
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=str)
    for w in want:
        assert any(w[:3] == m[:3] and math.isclose(w[3], m[3], abs_tol=1e-6) and math.isclose(w[4], m[4], rel_tol=1e-4, abs_tol=1e-3) for m in mine), w
    assert len(mine) == len(rows)


def test_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = q.op13_lmscore(spark, DATA)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = out.collect()
    c = Counter(w for i, t in rows.items() if not held(i) for w in words_of(t))
    n, kinds = sum(c.values()), len(c)
    assert len(out) == len(rows)
    for r in out:
        ws = words_of(rows[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + kinds + 1)) for w in ws), rel_tol=1e-9, abs_tol=1e-9)
    ours, base = (sum(r[k] for r in out if r.held_out) for k in ("score", "base_score"))
    assert ours > base


def test_odd_tables(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    assert lm.text_scores(df.where("false")).count() == 0
    alone = lm.text_scores(spark.createDataFrame([(5, "a b"), (2, None)], "doc_id long, text string")).collect()
    assert len(alone) == 2 and all(math.isfinite(r.score) and r.score <= 0 for r in alone)
    # nothing to learn from: only the end and unknown words, one of each bucket
    only = spark.createDataFrame([(next(i for i in range(99) if held(i)), "a b")], "doc_id long, text string")
    (r,) = lm.text_scores(only).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isclose(r.score, 3 * math.log10(1 / (lm.BUCKETS + 1)), rel_tol=0.05)
    assert len(lm.text_scores(df).collect()) == len(ODD)


def test_sums_by_row_and_contexts():
    at, grad = np.array([3, 1, 3, 0]), np.arange(8.0).reshape(4, 2)
    sums, rows = lm._by_row(at, grad)
    assert rows.tolist() == [0, 1, 3] and sums.tolist() == [[6, 7], [2, 3], [4, 6]]
    second, first = lm.contexts(np.array([5, 6, 0, 7, 0, 0]), np.array([0, 3, 5]))
    assert first.tolist() == [0, 5, 6, 0, 7, 0] and second.tolist() == [0, 0, 5, 0, 0, 0]


def test_noise_contrast_learns_a_bigram():
    r = np.random.default_rng(1)
    first = r.integers(0, 4, 40_000)
    word = np.where(r.random(40_000) < 0.9, (first + 1) % 4, r.integers(0, 4, 40_000))
    counts = np.bincount(word, minlength=4).astype(float)
    net = lm.untrained(4)
    t = lm.Trainer(net, lm.shares(counts), 0)
    for a in list(range(0, 40_000, 500)) * 4:
        t.step(np.zeros(500, int), first[a : a + 500], word[a : a + 500])
    far, near = lm.tables(net, counts)
    p = np.exp(far[0] + near)
    p /= p.sum(axis=1, keepdims=True)
    assert all(0.8 < p[k, (k + 1) % 4] < 0.97 for k in range(4)), p
