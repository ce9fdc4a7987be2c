"""Language-model scoring: a log-bilinear neural network trained in numpy by noise-contrastive estimation.

Tokens are words and one end by text. The network knows a fixed number of classes: the most frequent tokens, each a class
of its own, and buckets of all other words by their last two bytes. It predicts a token's class from the classes of the
two before it: the sum of their vectors (one table for each place), times the class's own vector, plus its bias. Within a
bucket a word has its share of the bucket's count in the training texts, and all unknown words of a bucket together have
the share of words seen once, so that the probabilities of all known words and the unknown sum to one.

Counts cover the whole corpus by a grouping. Training goes once over all training texts, a part of them in each round:
every task trains a copy on its rows, and copies are averaged by their tokens. Products of whole tables give each pair
of classes its score and each pair of classes before a token its normaliser; scoring looks them up.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, others, written
from .learn import fold, lowered

END = b""
#: Frequent tokens with a class of their own (the end is one of them), buckets of other words, and numbers in a vector.
WORDS, BUCKETS, WIDTH = 1792, 256, 32
#: Words whose counts every task holds; the others' are joined. Longer words (in bytes) are always among the others.
HELD, HELD_BYTES = 60_000, 64
#: Parts of the training texts between which copies are averaged, tokens of a step, words of noise of a step, step size.
ROUNDS, STEP, NOISE, RATE = 3, 1024, 48, 0.05
#: Distinct words a task counts, or texts it scores, before it passes them on; tokens of a text looked at together.
COUNTED, TOGETHER = 300_000, 1 << 18


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A to Z in lower case, and the end. bytes.split splits at U+0020 and U+0009 to U+000D."""
    return [*lowered(text or "").split(), END]


def bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word[-2:]) % buckets


def _bucket(word: Column, buckets: int) -> Column:
    return (F.crc32(F.substring(word, -2, 2)) % buckets).cast("int")


def held_out_rows(id_col: str, of: int = 7, at: int = 2) -> Column:
    """Whether a text is held out; those without an id aren't."""
    return F.coalesce(fold(id_col, of) == at, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes), c: how often each token stands in the texts; the end is the empty word."""

    def batch(seen):
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "c"])

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                seen.update(tokens(text.as_py()))
                if len(seen) > COUNTED:
                    yield batch(seen)
                    seen = Counter()
        yield batch(seen)

    return texts.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Corpus:
    """What every task holds of the training texts: of fixed size, whatever theirs.

    Classes: the end is 0, buckets follow, then words of their own by falling count. counts are by class; the two logs
    (of base 10) by bucket are of one count's share of its bucket, and of the share of the unknown.
    """

    n: int
    kinds: int
    held: dict[bytes, int]
    own: dict[bytes, int]
    counts: np.ndarray
    log_known: np.ndarray
    log_unknown: np.ndarray

    @property
    def base(self) -> float:
        return math.log10(self.n + self.kinds + 1)

    def classes(self, words: list[bytes]) -> list[int]:
        own, buckets = self.own.get, len(self.log_known)
        return [k if (k := own(w)) is not None else 1 + bucket(w, buckets) for w in words]


def corpus_of(counts: DataFrame, words: int = WORDS, buckets: int = BUCKETS, most: int = HELD) -> Corpus:
    """From word counts: totals, the most frequent words and the buckets' sums; at most so many words and buckets come here."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    short = F.length("word") <= HELD_BYTES
    hist = counts.groupBy(level.alias("level")).agg(F.count_if(short).alias("words"), F.sum("c").alias("n"), F.count("*").alias("kinds")).collect()
    room, least = most, math.inf
    for r in sorted(hist, key=lambda r: -r.level):
        room -= r.words
        if room < 0:
            break
        least = r.level
    top = counts.where(short & (level >= least)).collect() if least < math.inf else []
    held = {bytes(r.word): r.c for r in sorted(top, key=lambda r: (-r.c, bytes(r.word)))}
    own = {END: 0} | {w: 1 + buckets + k for k, w in enumerate([w for w in held if w != END][:words])}
    at, seen, once = np.zeros(buckets + len(own)), np.zeros(buckets), np.zeros(buckets)
    for r in counts.groupBy(_bucket(F.col("word"), buckets).alias("b")).agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once"), F.max(F.when(F.length("word") == 0, F.col("c"))).alias("ends")).collect():
        seen[r.b], once[r.b] = r.n - (r.ends or 0), r.once - (r.ends == 1)
        at[0] += r.ends or 0
    for w, k in own.items():
        if k:
            at[k] = held[w]
            seen[bucket(w, buckets)] -= held[w]
            once[bucket(w, buckets)] -= held[w] == 1
    at[1 : 1 + buckets] = seen
    unknown = np.where(seen > 0, (once + 1) / (seen + 2), 1.0)
    with np.errstate(divide="ignore"):
        known = np.where(seen > 0, np.log10(1 - unknown) - np.log10(np.maximum(seen, 1)), 0.0)
    return Corpus(sum(r.n for r in hist), sum(r.kinds for r in hist), held, own, at, known, np.log10(unknown))


@dataclass
class Net:
    """Vectors of the two classes before a token and of its own, and a bias added to the log share of the class.

    gathered has, for each of the four and each class, the squares of what moved it so far.
    """

    second: np.ndarray
    first: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    gathered: np.ndarray

    def rows(self) -> np.ndarray:
        return np.concatenate([self.second, self.first, self.out, self.bias[:, None], self.gathered.T], axis=1)

    @staticmethod
    def of(rows: np.ndarray) -> Net:
        w = (rows.shape[1] - 5) // 3
        second, first, out, rest = (np.array(x, np.float32) for x in np.split(rows, [w, 2 * w, 3 * w], axis=1))
        return Net(second, first, out, rest[:, 0].copy(), rest[:, 1:].T.copy())


def untrained(n: int, width: int = WIDTH, seed: int = 13) -> Net:
    r = np.random.default_rng(seed)
    table = lambda: r.normal(scale=0.1, size=(n, width)).astype(np.float32)
    return Net(table(), table(), table(), np.zeros(n, np.float32), np.full((4, n), 1e-3, np.float32))


def shares(counts: np.ndarray) -> np.ndarray:
    """Each class's share of the training tokens, none of them zero: the noise."""
    return (counts + 1) / (counts.sum() + len(counts))


class Trainer:
    """Noise-contrastive steps with a step size by row that shrinks with what the row has gathered."""

    def __init__(self, net: Net, noise: np.ndarray, seed: int, rate: float = RATE):
        self.net, self.noise, self.rate, self.r = net, np.cumsum(noise), rate, np.random.default_rng(seed)

    def _move(self, k: int, table: np.ndarray, grad: np.ndarray, rows: np.ndarray | slice) -> None:
        size = np.square(grad).sum(axis=1) / grad.shape[1] if grad.ndim == 2 else np.square(grad)
        gathered = self.net.gathered[k]
        gathered[rows] += size
        step = self.rate / np.sqrt(gathered[rows])
        table[rows] += grad * (step[:, None] if grad.ndim == 2 else step)

    @np.errstate(over="ignore")
    def step(self, second: np.ndarray, first: np.ndarray, word: np.ndarray) -> None:
        """One step from tokens with their two classes before; the same words of noise serve all of them."""
        net = self.net
        ghosts = np.minimum(np.searchsorted(self.noise, self.r.random(NOISE)), len(self.noise) - 1)
        q = net.second[second] + net.first[first]
        own = net.out[word]
        ghost = net.out[ghosts]
        # a class's score beyond its share's log; the share itself cancels against the noise's
        true = 1 / (1 + np.exp((q * own).sum(axis=1) + net.bias[word] - math.log(NOISE)))
        false = -1 / (1 + np.exp(math.log(NOISE) - q @ ghost.T - net.bias[ghosts]))
        towards = true[:, None] * own + false @ ghost
        for k, (table, at, grad) in enumerate(((net.second, second, towards), (net.first, first, towards), (net.out, word, true[:, None] * q))):
            self._move(k, table, *_by_row(at, grad))
        self._move(3, net.bias, np.bincount(word, true, len(net.bias)).astype(np.float32), slice(None))
        self._move(2, net.out, *_by_row(ghosts, false.T @ q))
        rows, grad = _by_row(ghosts, false.sum(axis=0)[:, None])[::-1]
        self._move(3, net.bias, grad[:, 0], rows)


def _by_row(at: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of grad's rows that share a number, those numbers)."""
    by = np.argsort(at, kind="stable")
    s = at[by]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return np.add.reduceat(grad[by], first, axis=0), s[first]


def contexts(word: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class two before, class before) of every token of joined texts that start at these places; before a text stand ends."""
    first, second = np.zeros_like(word), np.zeros_like(word)
    first[1:], second[2:] = word[:-1], word[:-2]
    first[starts] = second[starts] = 0
    later = starts + 1
    second[later[later < len(word)]] = 0
    return second, first


def _joined(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.fromiter((k for t in texts for k in t), np.int32, int(size.sum())), np.cumsum(size) - size


def _texts_of(batches, corpus: Corpus):
    """Classes of texts, joined to about TOGETHER tokens: (classes, where texts start)."""
    held: list[list[int]] = []
    size = 0
    for b in batches:
        for text in b["text"]:
            held.append(corpus.classes(tokens(text.as_py())))
            size += len(held[-1])
            if size >= TOGETHER:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def trained_net(texts: DataFrame, corpus: Corpus, rounds: int = ROUNDS, width: int = WIDTH) -> Net:
    """The network after one pass over all texts in so many rounds, each over a part of them and averaged over its tasks.

    Tasks train on the rows of their partitions, so that another partitioning gives slightly other numbers.
    """
    spark = texts.sparkSession
    net, noise = untrained(len(corpus.counts), width), shares(corpus.counts)
    shared = spark.sparkContext.broadcast(corpus)
    columns = 3 * width + 5
    schema = "k int, n long" + "".join(f", x{i} double" for i in range(columns))
    for part in range(rounds):
        rows = net.rows()

        def run(batches, rows=rows, part=part):
            trainer, n = Trainer(Net.of(rows), noise, part), 0
            for word, starts in _texts_of(batches, shared.value):
                second, first = contexts(word, starts)
                for a in range(0, len(word), STEP):
                    trainer.step(second[a : a + STEP], first[a : a + STEP], word[a : a + STEP])
                n += len(word)
            if n:
                out = trainer.net.rows().astype(np.float64) * n
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(np.full(len(out), n)), *map(pa.array, out.T)], names=["k", "n", *(f"x{i}" for i in range(columns))])

        some = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == part).select("text").mapInArrow(run, schema)
        found = some.groupBy("k").agg(*[(F.sum(f"x{i}") / F.sum("n")).alias(f"x{i}") for i in range(columns)]).collect()  # a row for each class
        for r in found:
            rows[r.k] = r[1:]
        net = Net.of(rows)
    shared.unpersist()
    return net


def tables(net: Net, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores (natural logs, not normalised) by class: of the class two before with the token's, and of the class before with it."""
    return net.second @ net.out.T, net.first @ net.out.T + net.bias + np.log(shares(counts)).astype(np.float32)


def normalisers(spark, net: Net, counts: np.ndarray) -> np.ndarray:
    """Natural log of the sum of all classes' exponentials by (class two before, class before); their number is fixed."""

    def run(batches):
        far, near = tables(net, counts)
        near = np.exp(near)
        for b in batches:
            k = b["id"].to_numpy()
            z = np.log(np.exp(far[k]) @ near.T).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([row.tobytes() for row in z], pa.binary())], names=["k", "z"])

    out = np.zeros((len(counts), len(counts)), np.float32)
    for r in spark.range(len(counts)).mapInArrow(run, "k long, z binary").collect():
        out[r.k] = np.frombuffer(r.z, np.float32)
    return out


@dataclass
class Model:
    corpus: Corpus
    net: Net
    z: np.ndarray


def fit(docs: DataFrame, text_col: str = "text", words: int = WORDS, buckets: int = BUCKETS, most: int = HELD) -> tuple[Model, DataFrame]:
    """The model of these texts and their word counts, a table under the shared folder."""
    texts = docs.select(F.col(text_col).alias("text"))
    counts = written(word_counts(texts))
    corpus = corpus_of(counts, words, buckets, most)
    net = trained_net(texts.where("text is not null"), corpus)
    return Model(corpus, net, normalisers(docs.sparkSession, net, corpus.counts)), counts


def class_logs(model: Model, tabs: tuple[np.ndarray, np.ndarray], word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token's class."""
    second, first = contexts(word, starts)
    return (tabs[0][second, word].astype(np.float64) + tabs[1][first, word] - model.z[second, first]) / math.log(10)


def with_scores(docs: DataFrame, model: Model, counts: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns but the text, with n_tokens, n_known, base_score and score; columns of these names are replaced.

    Words that tasks hold count where they stand. Of the others a row for each distinct one of a text meets the table of
    counts. Null texts count as empty: they hold the end alone. No texts: no rows.
    """
    kept = [docs.schema[c.strip("`")] for c in others(docs, text_col, "n_tokens", "n_known", "base_score", "score")]
    names = fresh(docs, "row_at", "row_text", "row_word", "row_n", "row_known", "row_base", "row_log")
    row, text, word, n, known, base, log = names
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        c, tabs = m.corpus, tables(m.net, m.corpus.counts)
        held = c.held
        # of a held word: log10(c + 1), and log10 of its share of its class
        worth = {w: (math.log10(x + 1), 0.0 if w in c.own else math.log10(x) + c.log_known[bucket(w, len(c.log_known))]) for w, x in held.items()}
        for b in batches:
            rare: list[list] = [[], [], []]
            whole: list[list] = [[], [], [], []]
            at, waiting, size = b.column(names[0]).to_pylist(), [], 0

            def flush():
                classes, starts = _joined([x[0] for x in waiting])
                logs = np.add.reduceat(class_logs(m, tabs, classes, starts), starts)
                for (k, i, seen), x in zip(waiting, logs):
                    base_sum, log_sum, known_n = -len(k) * c.base, float(x), 0
                    for w, count in seen.items():
                        if (values := worth.get(w)) is not None:
                            base_sum += count * values[0]
                            log_sum += count * values[1]
                            known_n += count
                        else:
                            rare[0].append(i)
                            rare[1].append(w)
                            rare[2].append(count)
                    for column, value in zip(whole, (len(k), known_n, base_sum, log_sum)):
                        column.append(value)
                waiting.clear()

            for i, t in zip(at, b.column(text)):
                words = tokens(t.as_py())
                waiting.append((c.classes(words), i, Counter(words)))
                size += len(words)
                if size >= TOGETHER:
                    flush()
                    size = 0
            if waiting:
                flush()
            sums = [pa.array(x, kind) for x, kind in zip(whole, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            out = [b.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*out, b.column(row), pa.nulls(b.num_rows, pa.binary()), *sums], names=[*(f.name for f in kept), row, *names[2:]])
            k = len(rare[0])
            if k:
                nothing = [pa.nulls(k, x.type) for x in (*out, *sums[1:])]
                yield pa.RecordBatch.from_arrays([*nothing[: len(out)], pa.array(rare[0]), pa.array(rare[1], pa.binary()), pa.array(rare[2]), *nothing[len(out) :]], names=[*(f.name for f in kept), row, *names[2:]])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept])
    for name, kind in zip((row, *names[2:]), ("long", "binary", "long", "long", "double", "double")):
        schema = schema.add(name, kind)
    log_known, log_unknown = (F.array(*[F.lit(float(x)) for x in v]) for v in (model.corpus.log_known, model.corpus.log_unknown))
    plain = [f"`{f.name}`" for f in kept]
    parts = written(docs.select(*plain, F.monotonically_increasing_id().alias(row), F.col(text_col).alias(text)).mapInArrow(run, schema))
    met = parts.where(F.col(word).isNotNull()).select(row, word, n).join(counts.select(F.col("word").alias(word), "c"), word, "left")
    place = _bucket(F.col(word), len(model.corpus.log_known)) + 1
    # an end that no training text has is a class of its own
    share = F.when(F.length(word) == 0, 0.0).when(F.col("c").isNull(), F.element_at(log_unknown, place)).otherwise(F.log10(F.col("c").cast("double")) + F.element_at(log_known, place))
    late = met.groupBy(row).agg(F.sum(F.when(F.col("c").isNotNull(), F.col(n)).otherwise(0)).alias("late_n"), F.sum(F.col(n) * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("late_base"), F.sum(F.col(n) * share).alias("late_log"))
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    out = parts.where(F.col(word).isNull()).join(late, row, "left")
    return out.select(*plain, F.col(n).alias("n_tokens"), plus(known, "late_n").alias("n_known"), plus(base, "late_base").alias("base_score"), plus(log, "late_log").alias("score"))


def text_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text, by a model of those not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out_rows(id_col).alias("held_out"), F.col(text_col).alias("text"))
    model, counts = fit(rows.where(~F.col("held_out")))
    out = with_scores(rows, model, counts)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.corpus.n).cast("long").alias("train_tokens"), "base_score", "score")
