"""One row of each group of near copies, against all pairs by hand."""

import itertools
import random

import pytest

from strataline.llm import nearcopies, simhash


def jaccard_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def edited(rng, text, share):
    return " ".join(f"new{rng.randrange(10**9)}" if rng.random() < share else w for w in text.split())


def by_hand(rows):
    sets = [jaccard_set(t) for _, t in rows]
    root = list(range(len(rows)))
    pairs = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            pairs.append((i, j))
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    return root, pairs


@pytest.mark.parametrize("common", ["", " ".join(f"line{i}" for i in range(40)) + " "])
def test_one_row_of_each_group(spark, common):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        base = common + " ".join(rng.choices([f"w{i}" for i in range(3000)], k=rng.randrange(60, 400)))
        texts += [base, *(edited(rng, base, rng.choice([0, 0.003, 0.01, 0.02, 0.03, 0.05])) for _ in range(6))]
    # a chain of copies of copies, short texts and empty ones
    for _ in range(15):
        texts.append(edited(rng, texts[-1], 0.01))
    texts += [None, "", " \t", "a b", "A  b", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    root, pairs = by_hand(rows)
    assert len(pairs) > 100 and 1 < len(set(root)) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = sorted(r.doc_id for r in simhash.one_of_each(df).collect())
    assert kept == sorted(set(root))


@pytest.mark.parametrize("n, links", [(40, 30), (60, 90), (30, 0), (25, 200)])
def test_components_through_hooks_are_those_of_all_links(spark, n, links):
    rng = random.Random(n)
    pairs = [tuple(sorted(rng.sample(range(n), 2))) for _ in range(links)]
    root = list(range(n))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    df = spark.createDataFrame(pairs, "a long, b long")
    half = len(pairs) // 2
    tied = nearcopies._tied(df)
    first = nearcopies._tied(spark.createDataFrame(pairs[:half], "a long, b long"))
    both = nearcopies._further(first, spark.createDataFrame(pairs[half:], "a long, b long"))
    want = {k: r for k, r in enumerate(root) if k != r}
    assert {r.node: r.component for r in tied.collect()} == want == {r.node: r.component for r in both.collect()}
