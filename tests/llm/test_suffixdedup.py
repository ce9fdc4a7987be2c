"""Against a brute-force reading of the contract: a set of the strings seen so far."""

import hashlib
import random

from strataline.llm import suffixdedup


def brute(texts, least=100):
    seen, out = set(), {}
    for d in sorted(texts):
        raw = (texts[d] or "").encode()
        gone = bytearray(len(raw))
        for x in range(len(raw) - least + 1):
            w = raw[x : x + least]
            if w in seen:
                gone[x : x + least] = b"\1" * least
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeäß") for _ in range(r.randint(1, 9)))
    passage = " ".join(word() for _ in range(60))
    line = " ".join(word() for _ in range(14))[:70]
    out = {}
    for d in range(60):
        body = " ".join(word() for _ in range(r.randint(0, 120)))
        if d % 3 == 0:
            a = r.randint(0, 40)
            body += passage[a : a + r.randint(60, 250)] + word()
        if d % 4 == 0:
            body = word() + line + body + line
        if d % 10 == 7:
            body = out[d - 5]
        out[d] = body
    return out | {60: "a" * 700, 61: "ab" * 300, 62: None, 63: "", 64: "b" + "a" * 130, 65: " " * 99}


def test_same_as_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.repeats_digest(docs).collect()}
    assert got == brute(texts)


def test_nulls_repeats_and_other_columns(spark):
    rows = [(None, "x" * 150, 1), (5, "y z " * 60, 2), (5, "y z " * 60, 2), (6, "y z " * 60, 3), (7, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, raw int")
    out = suffixdedup.without_repeats(docs).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "raw"} and len(out) == 5
    by = {r.doc_id: r.text for r in out}
    assert by[7] is None and by[6] == "" and by[5].startswith("y z ") and len(by[5]) < 240
    assert suffixdedup.repeats_digest(docs.where("false")).count() == 0
