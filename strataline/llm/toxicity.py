"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The kernel of two words counts the three-letter subsequences they share, each weighted by DECAY for every letter it
spans (SPAN letters at most), so that an insult with letters put in or left out still resembles itself; it is
normalised and raised to POWER, an integer, so that it stays a kernel. A sentence's kernel with a landmark is the sum
over its words (a convolution kernel). Landmarks are words of the training sentences, unlike each other, of toxic and of
clean documents; the inverse root of their kernel matrix maps sentences to Nystroem features, on which the machine is
trained. A toxic document's label says only that some sentence of it is toxic, so that its highest-scoring sentence is
taken as the witness, in a few rounds; the first witnesses come from a ridge regression over whole documents. Each
witness trains the machine a second time with a letter put into its telling word.

The machine is linear in the features and these add up over words, so that every distinct word has one weight; a
document's score is the logistic of its worst sentence's sum, scaled on training documents that the machine hasn't seen.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, only, others, slices
from .learn import fold, labelled_rows, trained

DECAY, SPAN, POWER = 0.8, 6, 2
#: Letters of a word that are looked at together; a longer word counts as its overlapping pieces, each a word.
PIECE, OVERLAP = 20, 10
#: Landmarks of toxic documents and of clean ones; no two of the former have a kernel above UNLIKE.
TELLING, COMMON, UNLIKE = 160, 32, 0.6
#: Labelled documents that training takes at most, and their characters in all.
TRAIN_ROWS, TRAIN_CHARS = 4000, 12_000_000
#: Words whose weight a worker remembers, and characters of texts that are looked at together.
REMEMBERED, AT_ONCE = 500_000, 1_000_000
#: Words of one length whose kernels are summed in one array; what they share with the landmarks is hundreds of times as many rows.
WORDS_AT_ONCE = 256

_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
#: Digits that are put for letters; whatever else isn't a letter is left out.
_LOOKS = str.maketrans("0134", "oiea")


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence; letters that stand alone, three or more in a row, form one word."""
    out = []
    for s in _SENTENCE.split(text):
        words = s.split()
        if list(map(len, words)).count(1) >= 3:
            joined, run = [], []
            for w in [*words, ""]:
                if len(w) == 1:
                    run.append(w)
                    continue
                joined += ["".join(run)] if len(run) >= 3 else run
                run = []
                joined.append(w)
            words = joined[:-1]
        if words:
            out.append(words)
    return out


def plain(word: str) -> str:
    """A word's letters in lower case; digits between letters count as those they look like."""
    w = word.lower()
    if not w.isalpha():
        if any(c in "0134" for c in w) and any(c.isalpha() for c in w):
            w = w.translate(_LOOKS)
        w = "".join(c for c in w if c.isalpha())
    return w


def pieces(word: str) -> list[str]:
    """The word's letters, in overlapping pieces where they are many; fewer than three letters are nothing."""
    w = plain(word)
    return [w[a : a + PIECE] for a in range(0, max(1, len(w) - OVERLAP), PIECE - OVERLAP)] if len(w) >= 3 else []


def _code_points(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.int64)


def _triples(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the gapped three-letter subsequences of a word of width letters, and their weights."""
    at = [(i, j, k) for i in range(width) for j in range(i + 1, min(i + SPAN - 1, width)) for k in range(j + 1, min(i + SPAN, width))]
    return np.array(at), np.array([DECAY ** (k - i + 1) for i, _, k in at])


def self_kernels(letters: np.ndarray, at: np.ndarray, much: np.ndarray) -> np.ndarray:
    """Each word's kernel with itself; subsequences that repeat in a word add up first."""
    out = np.full(len(letters), np.square(much).sum())
    order = np.sort(letters, axis=1)
    again = np.flatnonzero((order[:, 1:] == order[:, :-1]).any(axis=1))
    if len(again):
        width = letters.shape[1]
        own = letters[again]
        first = (own[:, :, None] == own[:, None, :]).argmax(axis=2)  # a letter as its first place in the word
        code = (first[:, at[:, 0]] * width + first[:, at[:, 1]]) * width + first[:, at[:, 2]]
        order = np.argsort(code, axis=1)
        code = np.take_along_axis(code, order, axis=1) + np.arange(len(own))[:, None] * width**3
        start = np.flatnonzero(np.r_[True, code.ravel()[1:] != code.ravel()[:-1]])
        sums = np.add.reduceat(much[order].ravel(), start)
        out[again] = np.bincount(start // len(at), np.square(sums), minlength=len(own))
    return out


class Kernel:
    """Normalised kernels of words with fixed landmark words, to the power POWER.

    Subsequences are numbered by the landmarks' letters; a letter that no landmark has can't be shared. Each number has
    the list of landmarks that hold it, so that a word meets only those it shares something with.
    """

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.alphabet = np.array(sorted({ord(c) for w in landmarks for c in w}), np.int64)
        what, which, much = [], [], []
        for m, w in enumerate(landmarks):
            letters = _code_points([w])
            at, weight = _triples(len(w))
            own, group = np.unique(self._numbers(letters, at)[0], return_inverse=True)
            what.append(own)
            which.append(np.full(len(own), m))
            much.append(np.bincount(group, weight) / np.sqrt(self_kernels(letters, at, weight)[0]))
        what, which, much = map(np.concatenate, (what, which, much))
        order = np.argsort(what, kind="stable")
        self.which, self.much = which[order], much[order]
        self.first = np.searchsorted(what[order], np.arange((len(self.alphabet) + 1) ** 3 + 1))

    def _numbers(self, letters: np.ndarray, at: np.ndarray) -> np.ndarray:
        base = len(self.alphabet) + 1
        i = np.minimum(np.searchsorted(self.alphabet, letters), base - 2)
        i = np.where(self.alphabet[i] == letters, i + 1, 0)
        return np.where((i[:, at] > 0).all(axis=2), (i[:, at[:, 0]] * base + i[:, at[:, 1]]) * base + i[:, at[:, 2]], 0)

    def of(self, words: list[str]) -> np.ndarray:
        """A row for each word (of three letters or more)."""
        many = len(self.landmarks)
        out = np.zeros((len(words), many), np.float32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for width in np.unique(size):
            same = np.flatnonzero(size == width)
            at, much = _triples(int(width))
            for a in range(0, len(same), WORDS_AT_ONCE):
                rows = same[a : a + WORDS_AT_ONCE]
                letters = _code_points([words[i] for i in rows])
                what = self._numbers(letters, at)
                start = self.first[what]
                held = self.first[what + 1] - start
                r, t = np.nonzero(held)
                start, held = start[r, t], held[r, t]
                hit = np.repeat(np.arange(len(start)), held)
                place = np.arange(len(hit)) - np.repeat(np.cumsum(held) - held, held) + start[hit]
                k = np.bincount(r[hit] * many + self.which[place], much[t[hit]] * self.much[place], minlength=len(rows) * many)
                out[rows] = (k.reshape(-1, many) / np.sqrt(self_kernels(letters, at, much))[:, None]) ** POWER
        return out


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray  # of the kernels with each landmark: the machine's normal through the Nystroem map
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word_weights(self, words: list[str]) -> np.ndarray:
        """The sum over each word's pieces."""
        own = [pieces(w) for w in words]
        flat = [p for o in own for p in o]
        if not flat:
            return np.zeros(len(words))
        owner = np.repeat(np.arange(len(own)), [len(o) for o in own])
        return np.bincount(owner, self.kernel.of(flat) @ self.weights, minlength=len(words))

    def worst(self, split: list[list[str]], known: dict[str, float]) -> float:
        """The highest sum of a sentence's words; 0 for a text without any."""
        return max((sum(map(known.__getitem__, s)) for s in split), default=0.0)

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (worst + self.bias) + self.shift, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 12) -> np.ndarray:
    """A linear support vector machine (squared hinge, last feature constant) by dual coordinate descent."""
    q = np.square(x).sum(axis=1) + 0.5 / cost
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost[i]
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic over scores, both labels weighing the same."""
    slope, shift = 1.0, 0.0
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(slope * score + shift, -40, 40)))
        g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        hess = np.array([[(h * score * score).sum() + 1e-6, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * score).sum() + 1e-5 * slope, g.sum()])
        slope, shift = slope - 0.5 * step[0], shift - 0.5 * step[1]
    return float(slope), float(shift)


def landmarks_of(docs: list[tuple[list[list[str]], int]]) -> list[str]:
    """Words of toxic documents' sentences that clean ones lack, by the lower end of their odds, each unlike those before; and common words of clean ones."""
    n = [sum(y == k for _, y in docs) for k in (0, 1)]
    seen = [Counter(), Counter()]
    for ss, y in docs:
        seen[y].update({w for s in ss for w in s})
    odds = {w: np.log((c - np.sqrt(c) + 0.1) / (n[1] + 1)) - np.log((seen[0][w] + np.sqrt(seen[0][w]) + 0.5) / (n[0] + 1)) for w, c in seen[1].items() if c >= 4}
    tried = sorted((w for w in odds if odds[w] > 0.7), key=lambda w: (-odds[w], w))[: 8 * TELLING]
    telling: list[str] = []
    if tried:
        gram = Kernel(tried).of(tried)
        own: list[int] = []
        for i in range(len(tried)):
            if len(own) < TELLING and (not own or gram[i, own].max() < UNLIKE):
                own.append(i)
        telling = [tried[i] for i in own]
    common = [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0])) if len(w) >= 4 and w not in set(telling)]
    return telling + common[:COMMON] or ["abc"]


def _put_in(word: str, rng: np.random.Generator) -> str:
    i = int(rng.integers(1, len(word)))
    return word[:i] + "abcdefghijklmnopqrstuvwxyz"[rng.integers(26)] + word[i:]


def _with_letters_put_in(told: list[tuple[list[str], np.ndarray]], kernel: Kernel, nystroem: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The features of witnesses once more, each with a letter put into the word that weighs most."""
    words = sorted({x for s, _ in told for x in s})
    weight = dict(zip(words, kernel.of(words) @ (nystroem @ w[:-1])))
    heavy = [max(s, key=weight.__getitem__) for s, _ in told]
    out = np.array([f for _, f in told], float)
    out[:, :-1] += (kernel.of([_put_in(x, rng) for x in heavy]) - kernel.of(heavy)) @ nystroem
    return out


def train(sample: list[tuple[str, int]]) -> Model:
    """A model from texts with labels 0 and 1; without words of both labels it scores every text alike.

    Three quarters train the machine; the rest, which it hasn't seen, scale its scores (few labels do both).
    """
    cut_up: dict[str, list[str]] = {}  # words stand many times: one copy of each

    def pieces_of(w: str) -> list[str]:
        own = cut_up.get(w)
        if own is None:
            own = cut_up[w] = pieces(w)
        return own

    docs = [([own for s in sentences(t) if (own := [p for w in s for p in pieces_of(w)])], y) for t, y in sample]
    cut_up.clear()
    n = [sum(y == k for _, y in docs) for k in (0, 1)]
    by_label = [[d for d in docs if d[1] == k] for k in (0, 1)]
    apart = min(n) >= 40
    unseen = [d for part in by_label for d in part[:: 4 if apart else 1]]
    docs = [d for part in by_label for i, d in enumerate(part) if (i % 4 or not apart) and d[0]]
    if {y for _, y in docs} != {0, 1}:
        share = n[1] / max(1, sum(n))
        return Model(Kernel(["abc"]), np.zeros(1), 0.0, 0.0, float(np.log((share + 0.01) / (1.01 - share))))
    kernel = Kernel(landmarks_of(docs))
    gram = kernel.of(kernel.landmarks).astype(float)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    nystroem = vector / np.sqrt(np.maximum(value, 1e-4))
    label = np.array([y for _, y in docs], float)
    # documents as bags: each landmark's closest sentence; kernels of words are kept for a few documents at a time
    bags = np.ones((len(docs), len(kernel.landmarks) + 1))
    ends = np.cumsum([len(ss) for ss, _ in docs])
    features = np.ones((ends[-1], bags.shape[1]), np.float32)
    feats = np.split(features, ends[:-1])
    for a in range(0, len(docs), 300):
        part = docs[a : a + 300]
        words = sorted({w for ss, _ in part for s in ss for w in s})
        at, of_word = {w: i for i, w in enumerate(words)}, kernel.of(words)
        for i, (ss, _) in enumerate(part):
            sums = np.array([of_word[[at[w] for w in s]].sum(axis=0) for s in ss])
            bags[a + i, :-1] = sums.max(axis=0)
            feats[a + i][:, :-1] = sums @ nystroem
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * len(docs)
    ridge = np.linalg.solve((bags * weight[:, None]).T @ bags + 10 * np.eye(bags.shape[1]), (bags * weight[:, None]).T @ (2 * label - 1))
    w = np.r_[np.linalg.lstsq(nystroem, ridge[:-1], rcond=None)[0], ridge[-1]]
    rng = np.random.default_rng(5)
    for _ in range(4):
        rows, ys, told = [], [], []
        for f, (ss, y) in zip(feats, docs):
            score = f @ w
            # the witness; of clean documents the hardest sentences and two others
            pick = [int(np.argmax(score))] if y else np.unique(np.r_[np.argsort(-score)[:2], rng.integers(0, len(f), 2)])
            rows.append(f[pick])
            ys += [1.0 if y else -1.0] * len(pick)
            if y:
                told.append((ss[pick[0]], f[pick[0]]))
        rows.append(_with_letters_put_in(told, kernel, nystroem, w, rng))
        ys += [1.0] * len(told)
        x, y = np.concatenate(rows, dtype=float), np.array(ys)
        del rows, told
        w = _svm(x, y, 0.5 * np.where(y > 0, (y < 0).sum() / max(1, (y > 0).sum()), 1.0))
    del features, feats, bags, x
    model = Model(kernel, nystroem @ w[:-1], float(w[-1]))
    tested = sorted({w for ss, _ in unseen for s in ss for w in s})
    known = {}
    for a in range(0, len(tested), 20_000):
        known.update(zip(tested[a : a + 20_000], (kernel.of(tested[a : a + 20_000]) @ model.weights).tolist()))
    score = [(model.worst(ss, known), y) for ss, y in unseen]
    # toxic ones a second time, with a letter put into the word that weighs most
    heavy = [max(max(ss, key=lambda s: sum(map(known.__getitem__, s))), key=known.__getitem__) for ss, y in unseen if y and ss]
    change = (kernel.of([_put_in(w, rng) for w in heavy]) - kernel.of(heavy)) @ model.weights
    score += [(v + c, 1) for v, c in zip([model.worst(ss, known) for ss, y in unseen if y and ss], change)]
    model.slope, model.shift = _platt(np.array([v for v, _ in score]) + model.bias, np.array([y for _, y in score], float))
    return model


_KNOWN: dict[str, dict[str, float]] = {}


def worst_sentences(texts: Iterable[str | None], model: Model) -> list[float]:
    """The worst sentence of each text. A worker remembers words for its later tasks, of one model."""
    only("toxicity", _KNOWN)
    if model.name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[model.name] = {}
    known, out = _KNOWN[model.name], []
    waiting: list[list[list[str]]] = []
    new: set[str] = set()
    chars = 0

    def settle() -> None:
        nonlocal chars
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new.update(w for split in waiting for s in split for w in s)
        words = list(new)
        for a in range(0, len(words), 50_000):
            known.update(zip(words[a : a + 50_000], model.word_weights(words[a : a + 50_000]).tolist()))
        out.extend(model.worst(split, known) for split in waiting)
        waiting.clear()
        new.clear()
        chars = 0

    for text in texts:
        split = sentences(text or "")
        waiting.append(split)
        for s in split:
            new.update(w for w in s if w not in known)
        chars += len(text or "")
        if chars >= AT_ONCE:
            settle()
    settle()
    return out


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """docs with out_col: a probability from the whole text's worst sentence. Null or empty text: that of no evidence.

    A column that has out_col's name, in any case of letters, is replaced. Repeated rows score alike; no rows give no rows.
    """
    kept = others(docs, out_col)
    (raw,) = fresh(docs, "text_to_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few megabytes, of fixed size

    def run(batches):
        for b in batches:
            worst = worst_sentences((t for part in slices([b]) for t in part.column(b.num_columns - 1).to_pylist()), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shared.value.probability(np.array(worst, float)))], names=[*b.schema.names[:-1], out_col])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(out_col, T.DoubleType())])
    return docs.select(*kept, F.col(text_col).alias(raw)).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample of the labelled rows outside the fifth that is held out, trained in one task."""
    return trained(labelled_rows(docs, labels, "toxic", fold("doc_id", 5) != 0, TRAIN_ROWS, TRAIN_CHARS), train)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; see with_toxicity for null and empty texts."""
    scored = with_toxicity(docs.select("doc_id", "text"), fit(docs, labels), "text", "score")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
