"""The kernel against an explicit sum over subsequences, scores against one text at a time, and insults with letters put in."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from strataline.llm import toxicity as tox
from strataline.llm.learn import fold, labelled_rows


def spectrum(word):
    out = defaultdict(float)
    for at in itertools.combinations(range(len(word)), 3):
        if at[2] - at[0] < tox.SPAN:
            out["".join(word[i] for i in at)] += tox.DECAY ** (at[2] - at[0] + 1)
    return out


def by_hand(a, b):
    x, y = spectrum(a), spectrum(b)
    dot = lambda u, v: sum(u[k] * v.get(k, 0) for k in u)
    return (dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))) ** tox.POWER


def test_kernel_is_the_sum_over_subsequences():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcéдя", k=rng.randrange(3, 21))) for _ in range(60)] + ["idiot", "idxiot", "aaa", "дурак", "привет", "собака"]
    kernel = tox.Kernel(words[::3] + ["idiot", "дурак"])
    got = kernel.of(words)
    for i, w in enumerate(words):
        for m, v in enumerate(kernel.landmarks):
            assert got[i, m] == pytest.approx(by_hand(w, v), abs=1e-5)
    assert by_hand("привет", "дурак") == 0 and by_hand("idiot", "idxiot") > 0.4
    gram = kernel.of(kernel.landmarks).astype(float)
    assert np.linalg.eigvalsh((gram + gram.T) / 2).min() > -1e-5


def corpus(n=120):
    rng = random.Random(9)
    plain = ["".join(rng.choices("etaoinshrdl", k=rng.randrange(4, 10))) for _ in range(400)]
    say = lambda: " ".join(rng.choices(plain, k=rng.randrange(4, 12)))
    out = []
    for i in range(n):
        text = ". ".join(say() for _ in range(5))
        out.append((text + f". {say()} {rng.choice(['grumpkin', 'wazzock', 'plonkervug'])} {say()}." if i % 3 == 0 else text, int(i % 3 == 0)))
    return out, say


def test_insults_with_letters_put_in_and_clean_texts():
    sample, say = corpus()
    model = tox.train(sample)
    p = lambda text: float(model.probability(np.array(tox.worst_sentences([text], model)))[0])
    for insult in ("grumpkin", "g-r-u-m-p-k-i-n", "g r u m p k i n", "grummpkin", "grumpxkin", "WAZZ0CK", "plonkervuug"):
        assert p(f"{say()} {insult} {say()}") > 0.5, insult
    assert np.mean([p(". ".join(say() for _ in range(5))) < 0.5 for _ in range(100)]) >= 0.97


def test_scores_do_not_depend_on_what_is_scored_together(monkeypatch):
    sample, say = corpus(60)
    model = tox.train(sample)
    texts = [t for t, _ in sample] + [None, "", " \n", "ab", "word " * 5000, "x" * 100_000, "ü" * 50, "\ud800a b"]
    whole = tox.worst_sentences(texts, model)
    tox._KNOWN.clear()
    monkeypatch.setattr(tox, "AT_ONCE", 10)
    monkeypatch.setattr(tox, "REMEMBERED", 30)
    assert np.allclose(whole, [tox.worst_sentences([t], model)[0] for t in texts])
    assert whole[len(sample)] == whole[len(sample) + 1] == whole[len(sample) + 2] == 0


def test_other_columns_and_repeats(spark):
    model = tox.train(corpus(30)[0])
    df = spark.createDataFrame([(1, "some text", 1.0, 2), (1, "some text", 1.0, 2), (None, None, None, None)], "doc_id long, text string, Toxicity double, text_to_score int")
    out = tox.with_toxicity(df, model)
    assert sorted(c.lower() for c in out.columns) == ["doc_id", "text", "text_to_score", "toxicity"]
    rows = out.select("toxicity", "text_to_score").collect()
    assert len(rows) == 3 and rows[0] == rows[1] and tox.with_toxicity(df.where("false"), model).count() == 0


def test_labelled_texts_without_words_score_alike(spark):
    docs = spark.createDataFrame([(i, "" if i % 2 else "good words here.") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows = tox.toxicity_scores(docs, labels).collect()
    assert len(rows) == 200 and len({r.score for r in rows}) == 1


def test_trained_in_a_task_as_on_the_driver(spark):
    texts = [f"{'you vile gr%dub' % (i % 3) if i % 2 else 'a kind word'} and number w{'abcdefg'[i % 7]}x." for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int").repartition(3)
    one = tox.fit(docs, labels)
    rows = labelled_rows(docs, labels, "toxic", fold("doc_id", 5) != 0, tox.TRAIN_ROWS, tox.TRAIN_CHARS).orderBy("place").collect()
    two = tox.train([(r.text, r.y) for r in rows])
    assert len(rows) > 200 and one.kernel.landmarks == two.kernel.landmarks
    assert (one.weights == two.weights).all() and (one.slope, one.shift) == (two.slope, two.shift)
