"""Quality by a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes slide over overlapping chunks that together cover the whole text; a chunk keeps each
filter's highest value, a text the mean and the highest of its chunks, and a logistic layer combines them. The first
layer is a table of weights by place in the filter, byte and filter, so that a convolution is WIDTH lookups and sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, others
from .learn import fold, labelled_sample

WIDTH, FILTERS = 5, 24
#: Bytes of a chunk; neighbours share WIDTH - 1 bytes, so that a filter's every place lies whole in one chunk.
CHUNK = 256
#: Chunks that are looked at together.
AT_ONCE = 64
#: Labelled documents that training takes at most, and their characters in all.
TRAIN_ROWS, TRAIN_CHARS, EPOCHS = 1600, 8_000_000, 14


class Net:
    """table: WIDTH x 256 x FILTERS, bias by filter; head over the means and the maxima of chunks, and a constant."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.head = r.normal(0, 0.2, 2 * FILTERS).astype(np.float32)
        self.constant = np.float32(0.0)

    def pooled(self, raw: bytes, places: bool = False):
        """Highest value of each filter by chunk (none below zero), and where each stands. No bytes: one chunk of zeros."""
        b = np.frombuffer(raw, np.uint8)
        n = len(b) - WIDTH + 1
        if n <= 0:
            b = np.r_[b, np.zeros(WIDTH - len(b), np.uint8)]
            n = 1
        out, at = [], []
        step = CHUNK - WIDTH + 1
        for a in range(0, n, step * AT_ONCE):
            z = min(n, a + step * AT_ONCE)
            x = self.table[0][b[a:z]]
            for k in range(1, WIDTH):
                x += self.table[k][b[a + k : z + k]]
            edges = np.arange(0, z - a, step)
            out.append(np.maximum.reduceat(x, edges, axis=0))
            if places:
                at += [x[e : e + step].argmax(axis=0) + e + a for e in edges]
        top = np.maximum(np.concatenate(out) + self.bias, 0)
        return (top, np.array(at), b) if places else top

    def logit(self, top: np.ndarray) -> float:
        return float(top.mean(axis=0) @ self.head[:FILTERS] + top.max(axis=0) @ self.head[FILTERS:] + self.constant)

    def probability(self, raw: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(self.pooled(raw)), -40, 40))))


def train(sample: list[tuple[str, int]], epochs: int = EPOCHS, batch: int = 16, rate: float = 0.01) -> Net:
    """A net from texts with labels 0 and 1, both weighing the same, by Adam; without both labels it scores every text alike."""
    net = Net()
    data = [(t.encode(), y) for t, y in sample]
    n = [sum(y == k for _, y in data) for k in (0, 1)]
    if not all(n):
        share = n[1] / max(1, sum(n))
        net.head[:] = 0
        net.constant = np.float32(np.log((share + 0.01) / (1.01 - share)))
        return net
    weight = [len(data) / (2 * c) for c in n]
    parts = ["table", "bias", "head", "constant"]
    first = {p: np.zeros_like(getattr(net, p)) for p in parts}
    second = {p: np.zeros_like(getattr(net, p)) for p in parts}
    r, step = np.random.default_rng(3), 0
    mean = {p: np.zeros_like(getattr(net, p), dtype=np.float64) for p in parts}
    averaged = 0
    for epoch in range(epochs):
        order = r.permutation(len(data))
        for a in range(0, len(order), batch):
            grad = {p: np.zeros_like(getattr(net, p)) for p in parts}
            for i in order[a : a + batch]:
                raw, y = data[i]
                top, at, b = net.pooled(raw, places=True)
                p = 1 / (1 + np.exp(-np.clip(net.logit(top), -40, 40)))
                g = np.float32(weight[y] * (p - y) / batch)
                best = top.argmax(axis=0)
                grad["head"] += g * np.r_[top.mean(axis=0), top.max(axis=0)]
                grad["constant"] += g
                back = np.tile(g * net.head[:FILTERS] / len(top), (len(top), 1))
                back[best, np.arange(FILTERS)] += g * net.head[FILTERS:]
                back *= top > 0
                grad["bias"] += back.sum(axis=0)
                c, f = np.nonzero(back)
                for k in range(WIDTH):
                    np.add.at(grad["table"][k], (b[at[c, f] + k], f), back[c, f])
            step += 1
            now = rate * (1 - epoch / epochs) + 1e-4
            for p in parts:
                g = grad[p] + (1e-4 * getattr(net, p) if p in ("table", "head") else 0)
                first[p] = 0.9 * first[p] + 0.1 * g
                second[p] = 0.999 * second[p] + 0.001 * g * g
                move = now * (first[p] / (1 - 0.9**step)) / (np.sqrt(second[p] / (1 - 0.999**step)) + 1e-8)
                setattr(net, p, (getattr(net, p) - move).astype(np.float32))
            if epoch >= epochs - 3:  # the last rounds' mean is steadier than the last step
                averaged += 1
                for p in parts:
                    mean[p] += getattr(net, p)
    for p in parts:
        setattr(net, p, (mean[p] / averaged).astype(np.float32))
    return net


def with_quality(docs: DataFrame, net: Net, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """docs with out_col, a probability from every byte of the text. Null and empty texts score as one chunk of zero bytes."""
    kept = others(docs, out_col)
    (raw,) = fresh(docs, "text_bytes")
    shared = docs.sparkSession.sparkContext.broadcast(net)  # about 120 kB whatever the data

    def run(batches):
        for b in batches:
            p = [shared.value.probability(t or b"") for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64())], names=[*b.schema.names[:-1], out_col])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(out_col, T.DoubleType())])
    return docs.select(*kept, F.col(text_col).cast("binary").alias(raw)).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame) -> Net:
    """The net of a bounded sample of the labelled rows outside the third that is held out."""
    return train(labelled_sample(docs, labels, "quality", fold("doc_id", 3) != 1, TRAIN_ROWS, TRAIN_CHARS))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; see with_quality for null and empty texts."""
    scored = with_quality(docs.select("doc_id", "text"), fit(docs, labels), "text", "score")
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
