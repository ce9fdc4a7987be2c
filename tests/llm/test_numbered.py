"""The other operators against brute force, round trips and held-out labels, with nulls, repeats, empty tables and clashing names."""

import hashlib
import itertools
import os
import zlib

import numpy as np
import public_tokenizers
import pytest

from strataline.llm import bytebpe, chat, packing, pii, quality, simhash, topk, toxicity, vectorjoin
from strataline.llm import queries as q

DATA = "/root/testdata/sf0.01"
TEXTS = [None, "", "a", "Héllo  wörld 123 don't", "x" * 5000, "the the the " * 200, "😀 mixed\r\n\n text\t", "Héllo  wörld 123 don't"]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, raw string")


def test_bpe_as_the_library_does(spark):
    import tiktoken

    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id % 25 = 0").collect()]
    got = bytebpe.encode_decode(docs_of(spark, texts).select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in got.collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def classes(n, linked):
    root = list(range(n))
    for a, b in linked:
        a, b = root[a], root[b]
        root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_simhash_links(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(300).collect()
    texts = TEXTS + [r.text for r in rows]
    got = {r.doc_id: r for r in simhash.simhash_digest(docs_of(spark, texts)).collect()}
    fps = [int(got[i].fingerprint, 16) for i in range(len(texts))]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert [got[i].component_id for i in range(len(texts))] == classes(len(texts), pairs)
    assert fps[0] == fps[1] == 0 and fps[3] == fps[7]


def test_fingerprints_within_the_distance_meet(spark):
    r = np.random.default_rng(1)
    base = r.integers(-(2**62), 2**62, 40)
    fps = {int(x) ^ (1 << int(a)) ^ (1 << int(b)) for x in base for a, b in r.integers(0, 62, (20, 2))} | {int(x) for x in base}
    fps = sorted(fps)
    got = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    at = {x: i for i, x in enumerate(fps)}
    mask = (1 << 64) - 1
    want = classes(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if ((fps[i] ^ fps[j]) & mask).bit_count() <= 2])
    assert classes(len(fps), [(at[x.a], at[x.b]) for x in got]) == want


def vectors(spark, r, n=400):
    v = r.normal(size=(n, 8))
    v[n // 2 :] = v[: n - n // 2] + r.normal(scale=0.25, size=(n - n // 2, 8))
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    odd = [(n, None), (n + 1, [0.0] * 8), (n + 2, [float("nan")] + [1.0] * 7), (n + 3, [None] + [1.0] * 7), (n + 4, rows[0][1])]
    return rows, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")


def test_vector_links(spark):
    rows, df = vectors(spark, np.random.default_rng(2))
    rows = rows + [(len(rows) + 4, rows[0][1])]
    m = np.array([x for _, x in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    ids = [i for i, _ in rows]
    root = classes(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if near[i, j]])
    got = {r.vec_id: r for r in vectorjoin.near_vectors(df, interval=64).collect()}
    assert [got[i].n_links for i in ids] == [int(near[k].sum()) - 1 for k in range(len(ids))]
    assert [got[i].component_id for i in ids] == [ids[k] for k in root]
    for i in range(400, 404):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert vectorjoin.near_vectors(df.where("false")).count() == 0


def test_top_k(spark):
    rows, df = vectors(spark, np.random.default_rng(4))
    rows = rows + [(len(rows) + 4, rows[0][1])]
    m = {i: np.floor(256 * np.array(x)).astype(int) for i, x in rows}
    want = set()
    for i in m:
        if i % 50 == 0:
            best = sorted((-int(m[i] @ m[j]), j) for j in m if j != i)[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    got = topk.top_k(df, df.vec_id % 50 == 0, query_block=4, cand_block=50)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == want


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id % 4 = 0").collect()]
    got = packing.pack(docs_of(spark, texts), path).collect()
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for d, rows in by_doc.items():
        assert sum(r.length for r in rows) == len(ids[d])
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_doc) == len(texts) and len(by_seq) <= sum(map(len, ids)) / 4096 * 1.05 + 2
    assert packing.pack(docs_of(spark, texts).where("false"), path).count() == 0


def test_pii_spans_and_masks(spark):
    texts = ["Mail a.b@c.de, card 4111 1111 1111 1111.", "ip 1.2.3.4 and 1.2.3.400", "tel +1 (499) 555-6503", "GB82 WEST 1234 5698 7654 32 iban", None, ""]
    df = docs_of(spark, texts)
    spans = [[(s.kind, s.start, s.end) for s in r.pii] for r in pii.find_pii(df).orderBy("doc_id").collect()]
    assert spans[0] == [("email", 5, 13), ("card", 20, 39)] and [s[0] for s in spans[1]] == ["ip"]
    assert ("phone", 4, 21) in spans[2] and spans[3][0][0] == "iban" and spans[4] == spans[5] == []
    masked = [r.text for r in pii.mask_pii(df).orderBy("doc_id").collect()]
    assert masked[0] == "Mail <email>, card <card>." and masked[4] is None and masked[5] == ""


@pytest.mark.parametrize("style", [("User: ", "Assistant: "), ("Human: ", "AI: "), ("### User\n", "### Assistant\n"), ("**User:** ", "**Assistant:** "), ("Q: ", "A: ")])
def test_chat_roles(style):
    said = [("user", "Can you help?\nNote: see below."), ("assistant", "Yes.\n\nFirst, do this."), ("user", "Thanks"), ("assistant", "Welcome")]
    text = "\n".join(style[r == "assistant"] + t for r, t in said)
    assert chat.turns(text) == said
    assert chat.turns(" \n") == [] and chat.turns("hello there")[0][1] == "hello there"


def test_chat_round_trip(spark):
    out = q.op6_chat(spark, DATA).collect()
    assert len(out) == 100 and sum(r.same_roles for r in out) >= 98
    empty = spark.createDataFrame([(1, 0, None, None), (None, 0, "user", "x")], "conv_id long, turn int, role string, text string")
    assert chat.chat_digest(empty).count() == 2


def held_out(rows, label):
    y = np.array([r[label] for r in rows])
    p = np.array([r.predicted for r in rows])
    return np.mean([(p[y == k] == k).mean() for k in (0, 1)])


@pytest.mark.parametrize(("op", "label", "least"), [(q.op2_toxicity, "toxic", 0.8), (q.op7_quality, "quality", 0.9)])
def test_held_out_accuracy(spark, op, label, least):
    sf = "/root/testdata/sf0.1"
    out = op(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label).where(f"{label} is not null").dropDuplicates(["doc_id"])
    rows = out.where("held_out").join(labels, "doc_id").collect()
    assert held_out(rows, label) >= least and all(0 <= r.score <= 1 for r in rows)


def test_classifiers_with_one_label_or_none(spark):
    df = docs_of(spark, TEXTS)
    for fit, score in ((toxicity.train, toxicity.with_toxicity), (quality.train, quality.with_quality)):
        rows = score(df, fit([("some text", 1)])).collect()
        assert len(rows) == len(TEXTS) and score(df.where("false"), fit([])).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffixdedup", "pii", "packing"]
    kept = corpus_pipeline.clean(spark, docs, DATA)
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.score for r in q.op2_toxicity(spark, DATA).collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, s in scores.items() if s < 0.5}
    once = corpus_pipeline.one_each(spark, docs, DATA)
    assert once.columns == docs.columns
    # one of each group of Jaccard similarity 0.8, by all pairs
    from test_near_copies import by_hand

    assert once.count() == len(set(by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])[0]))
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
