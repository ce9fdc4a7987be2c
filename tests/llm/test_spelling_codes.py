"""Spelling groups and vector codes against brute force, with nulls, ties, repeats, long runs, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from strataline.llm import codes, spelling
from strataline.llm import queries as q

DATA = "/root/testdata/sf0.001"


def counted_by_hand(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups_by_hand(n):
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def groups(df):
    return {tuple(r) for r in spelling.spelling_groups(df).collect()}


def test_groups_as_by_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()][:60]
    r = random.Random(3)
    base = ["aaaaa", "abcde", "abcdé", "straße", "größer", "schreiben", "aaaabaaaa"]
    made = []
    for w in base * 40:
        k = r.randrange(len(w))
        made += [w] * r.randrange(1, 5) + [r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abÀ×ÿ") + w[k:], w[:k] + r.choice("abé") + w[k + 1 :], w.upper()])]
    rows += [(None, None), (None, " ".join(made)), (7, " ".join(made[::3])), (7, " ".join(made[::3])), (-1, "")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, WID int, k1 string").repartition(3)
    n = counted_by_hand(rows)
    assert len(n) > 300 and groups(df) == groups_by_hand(n)


def test_ties_chains_and_spoiled_runs(spark):
    n = {"abcdef": 40, "abcdeg": 20, "abcdhg": 10, "abcihg": 5, "abcd": 99, "zzzzzz": 20, "zzzzz": 10, "yzzzzz": 20}
    df = spark.createDataFrame([(1, " ".join(w for w, c in n.items() for _ in range(c)))], "doc_id long, text string")
    got = groups(df)
    assert got == groups_by_hand(counted_by_hand([(1, df.first().text)]))
    assert ("abcihg", "abcdhg", "abcdef", 5, 1, 10) in got and ("zzzzz", "yzzzzz", "yzzzzz", 10, 2, 20) in got
    assert groups(df.where("false")) == set() == groups(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string"))


def test_a_run_of_very_many_letters(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcd") for _ in range(200_000))
    other = long[:100_000] + "z" + long[100_001:]
    rows = [(1, " ".join([long] * 8)), (2, " ".join([other] * 3)), (3, " ".join([long[1:]] * 4))]
    got = {(len(w), n, near, f is not None) for w, f, _, n, near, _ in groups(spark.createDataFrame(rows, "doc_id long, text string"))}
    want = counted_by_hand(rows)
    assert {(len(w), n) for w, n in want.items()} == {(a, b) for a, b, _, _ in got} and (200_000, 3, 1, True) in got


def test_fingerprints_are_of_their_strings():
    words = ["abcde", "aabbcc", "ÿ" * 7, "bcdea"]
    strings = lambda w: [w] + [w[:i] + w[i + 1 :] for i in range(len(w)) if i == 0 or w[i] != w[i - 1]] + [w[:i] + "\1" + w[i + 1 :] for i in range(len(w))]

    def key(s):
        h = [sum(ord(c) * pow(b, j, p) for j, c in enumerate(s)) % p for p, b in zip(spelling.PRIMES, spelling.BASES)]
        return h[0] << 31 | h[1], h[2] << 31 | h[3]

    row, kind, k1, k2 = spelling.fingerprints(words)
    for i, w in enumerate(words):
        assert sorted(zip(k1[row == i].tolist(), k2[row == i].tolist())) == sorted(map(key, strings(w)))
    assert spelling.fingerprints([])[0].size == 0


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    """rows of (id, vector, label), all usable and of one length."""
    m = np.array([np.floor(1024 * np.array(v, float)) for _, v, _ in rows]).astype(int)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], list(rows[i][1])))
    split = np.split(m, parts, axis=1)
    books = [x[order[:entries]].copy() for x in split]
    dist = lambda x, b: ((x[:, None, :] - b[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for x, b in zip(split, books):
            at = dist(x, b).argmin(axis=1)
            for k in set(at):
                b[k] = x[at == k].sum(axis=0) // (at == k).sum()
    d = [dist(x, b) for x, b in zip(split, books)]
    code = ["".join(f"{x[i].argmin():02x}" for x in d) for i in range(len(rows))]
    err = [int(sum(x[i].min() for x in d)) for i in range(len(rows))]
    by = Counter()
    for (_, _, lab), e in zip(rows, err):
        by[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    return sorted((i, c, e, by[lab], sha) for (i, _, lab), c, e in zip(rows, code, err))


SCHEMA = "vec_id long, embedding array<double>, label int, v string, Code int"


def test_codes_as_by_all_entries(spark):
    r = np.random.default_rng(7)
    rows = [(i, list(map(float, v)), [None, 1, 2][i % 3]) for i, v in enumerate(r.normal(scale=0.1, size=(700, 8)))]
    rows += [(900 + i, rows[i][1], None) for i in range(200)] + [(5, rows[9][1], 1), (2000, [0.0] * 8, 2), (2001, [3e3] + [0.0] * 7, 2)]
    odd = [(1, None, 1), (2, [float("nan")] * 8, 1), (3, [None] + [0.0] * 7, 1), (4, [float("inf")] + [0.0] * 7, None)]
    df = spark.createDataFrame([(*x, "w", 3) for x in rows + odd], SCHEMA).repartition(5)
    got = sorted(tuple(x) for x in codes.vector_codes(df).collect())
    assert got == codes_by_hand(rows)


def test_few_vectors_ties_and_odd_lengths(spark):
    rows = [(i, [float(i % 3), 0.5, -0.25, 1.0], None) for i in range(6)]
    df = spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA)
    assert sorted(tuple(x) for x in codes.vector_codes(df).collect()) == codes_by_hand(rows)
    more = df.union(spark.createDataFrame([(50, [1.0] * 8, 1, None, None), (51, [1.0] * 3, 1, None, None), (None, [0.0, 0.5, 0.5, 1.0], 1, None, None)], SCHEMA))
    got = {x.vec_id: x for x in codes.vector_codes(more).collect()}
    assert len(got) == 9 and got[50].code is None is got[51].error and got[None].code is not None and got[50].label_error == got[None].error
    assert codes.vector_codes(df.where("false")).count() == 0
    assert [x.code for x in codes.vector_codes(spark.createDataFrame([(1, [1.0], 1, None, None), (2, [], 1, None, None)], SCHEMA)).collect()] == [None, None]
    with pytest.raises(Exception, match="smaller scale"):
        codes.vector_codes(spark.createDataFrame([(1, [1e9] * 4, 1, None, None)], SCHEMA)).collect()


def test_nearest_of_large_integers():
    r = np.random.default_rng(2)
    for top in (3, 1000, 1 << 27):
        x, e = r.integers(-top, top, (600, 4)), r.integers(-top, top, (200, 4))
        d = ((x[:, None, :] - e[None]) ** 2).sum(axis=2)
        at, best = codes.nearest(x, e)
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_codes_as_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    rel = db.execute(codes.oracle())
    cols = [c[0] for c in rel.description]
    out = q.op12_codes(spark, DATA)
    assert sorted(tuple(x) for x in out.select(*cols).collect()) == sorted(rel.fetchall())
