"""Near copies of whole texts: all links of a Jaccard similarity of AT_LEAST between sets of five-word shingles, exactly.

Two sets that are so similar share a shingle among the first of each, in any one order of all shingles (prefix
filtering): of n shingles those at the first n - ceil(AT_LEAST n) + 1 places. Rare shingles come first in the order, then
common ones, the most common last, and equally common ones by their hashes: so a line that very many unlike texts hold is
among the first of few. Which are common is counted in one text of COUNTED; any order finds all pairs, this one only meets
fewer others.

Sets that meet under a shingle are candidates where their sizes and the shingle's places in them allow the similarity;
the shingles of both then decide. Nothing is estimated, so no pair is missed.

Candidates are tried in three rounds. The first takes pairs that SimHash fingerprints propose (see simhash) and pairs
everything under a shingle with the set there whose shingles are shared most, which is the likeliest to be what the others
were copied from; that takes one candidate for each row. The other two try only pairs that are still in different
components: the second of each set under a shingle the likeliest partner, the third all. So a large group of near copies
costs about as many rows as it has members, unless it holds together by few links. Pairs under a shingle that many unlike
texts share are thinned by a bound: the bits in which two sets' sketches differ are at most the shingles in which the sets
do. A wider sketch, of two bits and more for each shingle, does the same for each pair that is left before the shingles
themselves are fetched.
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, fresh, only, slices, written
from .components import components

WORDS_EACH, AT_LEAST = 5, Fraction(4, 5)
#: Longs of a sketch: bit b of a set's sketch is the parity of its shingles of hash b modulo the bits.
SKETCH = 4
#: Candidate pairs compared in one array.
BLOCK = 1 << 20
#: A shingle is common that OFTEN or more of the texts counted hold (one in COUNTED), if no more than COMMON are so.
COUNTED, OFTEN, COMMON = 8, 3, 1 << 17


def shingles(text: bytes, words_each: int = WORDS_EACH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words are one shingle, and so are no words."""
    words = text.lower().split()
    if len(words) <= words_each:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 7)], np.uint64)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    raw = b"".join([xxhash.xxh64_digest(joined[a : b - 1], 7) for a, b in zip([0, *ends], ends[words_each - 1 :])])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def sketch_of(own: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_be_similar(nx: int, ny: int, x: bytes, y: bytes) -> bool:
    """By wide sketches; of two widths the wider is folded."""
    need = -(-(nx + ny) * AT_LEAST.numerator // (AT_LEAST.numerator + AT_LEAST.denominator))
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(u) != len(v):
        u, v = (u, v) if len(u) > len(v) else (v, u)
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    return need <= min(nx, ny) and int(np.bitwise_count(u ^ v).sum(dtype=np.int64)) <= nx + ny - 2 * need


def set_name(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes(), 3)


def with_set(docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """docs with a long column out_col, equal for texts of equal shingle sets. Null text counts as empty."""

    def run(batches):
        for b in slices(batches):
            names = np.array([set_name(shingles(t or b"")) for t in b[b.schema.names[-1]].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.int64())], names=[*b.schema.names[:-1], out_col])

    (raw,) = fresh(docs, f"{out_col}_bytes")
    return docs.select("*", F.col(text_col).cast("binary").alias(raw)).mapInArrow(run, docs.select("*").schema.add(out_col, "long"))


def _sets(texts: DataFrame) -> DataFrame:
    """From sid, text: sid, n (shingles), sketch and wide (bytes)."""

    def run(batches):
        only("nearcopies")
        for b in slices(batches):
            own = [shingles(t or b"") for t in b["text"].to_pylist()]
            sketch = [sketch_of(x, 64 * SKETCH) for x in own]
            wide = [sketch_of(x, max(64 * SKETCH, 1 << (2 * len(x) - 1).bit_length())) for x in own]
            yield pa.RecordBatch.from_arrays([b["sid"], pa.array([len(x) for x in own], pa.int32()), pa.array(sketch, pa.binary()), pa.array(wide, pa.binary())], names=["sid", "n", "sketch", "wide"])

    return texts.select("sid", F.col("text").cast("binary").alias("text")).mapInArrow(run, "sid long, n int, sketch binary, wide binary")


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted common shingles and how many of the texts counted hold each: at most COMMON, the most common ones."""

    def run(batches):
        for b in slices(batches):
            own = [shingles(t or b"") for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own or [np.zeros(0, np.uint64)]).view(np.int64))], names=["key"])

    counted = texts.where(F.pmod(F.xxhash64("sid"), F.lit(COUNTED)) == 0).select(F.col("text").cast("binary").alias("text"))
    held = written(counted.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") >= OFTEN))
    least, so_far = OFTEN, 0
    for r in sorted(held.groupBy("many").count().collect(), reverse=True):  # a row for each number of texts that occurs
        so_far += r["count"]
        if so_far > COMMON:
            least = r.many + 1
            break
    found = held.where(F.col("many") >= least).toArrow()
    discard(held)
    key, many = found["key"].to_numpy().view(np.uint64), found["many"].to_numpy()
    at = np.argsort(key)
    return key[at], many[at]


def ordered(own: np.ndarray, key: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Sorted shingles in the order of the prefixes: those not in key, then the others by many."""
    if not len(key):
        return own
    at = np.minimum(np.searchsorted(key, own), len(key) - 1)
    return own[np.argsort(np.where(key[at] == own, many[at], 0), kind="stable")]


def _prefixes(texts: DataFrame, key: np.ndarray, many: np.ndarray) -> DataFrame:
    """key (a shingle), sid, n, pos for the first shingles of each set, where key are common ones that many texts hold."""
    common = texts.sparkSession.sparkContext.broadcast((key, many))

    def run(batches):
        for b in slices(batches):
            own = [ordered(shingles(t or b""), *common.value) for t in b["text"].to_pylist()]
            n = np.array([len(x) for x in own], np.int32)
            many = [k - math.ceil(AT_LEAST * k) + 1 for k in n.tolist()]
            at = np.repeat(np.arange(len(n)), many)
            key = np.concatenate([x[:m] for x, m in zip(own, many)] or [np.zeros(0, np.uint64)])
            pos = np.concatenate([np.arange(m) for m in many] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b["sid"].take(pa.array(at)), pa.array(n[at]), pa.array(pos.astype(np.int32))], names=["key", "sid", "n", "pos"])

    return texts.select("sid", F.col("text").cast("binary").alias("text")).mapInArrow(run, "key long, sid long, n int, pos int")


def _shingled(texts: DataFrame) -> DataFrame:
    """sid, own (the shingles as bytes)."""

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b["sid"], pa.array([shingles(t or b"").tobytes() for t in b["text"].to_pylist()], pa.binary())], names=["sid", "own"])

    return texts.select("sid", F.col("text").cast("binary").alias("text")).mapInArrow(run, "sid long, own binary")


def _apart(batches, best: bool = False):
    """Rows sorted by key, n: pairs of one key, of different components, that sizes, places and sketches allow.

    best: of each row's pairs (in an array of BLOCK) only that whose sketches leave most room.
    """
    held = None
    up, down = AT_LEAST.numerator, AT_LEAST.denominator

    def pairs(key, n, pos, sid, comp, sketch):
        # where each row's candidates end: the key's last row of at most n / AT_LEAST shingles
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for a, z in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
            size = n[a:z].astype(np.int64)
            reach = np.searchsorted(size, size * down // up, side="right")
            step = max(1, BLOCK // (z - a))
            for r in range(0, z - a, step):
                i = np.arange(r, min(r + step, z - a))
                many = np.maximum(reach[i] - i - 1, 0)
                first = np.repeat(i, many)
                second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
                x, y = a + first, a + second
                ok = comp[x] != comp[y]
                x, y = x[ok], y[ok]
                nx, ny = n[x].astype(np.int64), n[y].astype(np.int64)
                need = -(-(nx + ny) * up // (up + down))
                ok = 1 + np.minimum(nx - pos[x] - 1, ny - pos[y] - 1) >= need
                x, y, most = x[ok], y[ok], (nx + ny - 2 * need)[ok]
                differ = np.zeros(len(x), np.int64)
                for own in sketch.T:  # one long at a time: all of a pair at once take as much room as all else here
                    differ += np.bitwise_count(own[x] ^ own[y])
                ok = differ <= most
                x, y, room = x[ok], y[ok], (most - differ)[ok]
                if best:
                    order = np.argsort(-room, kind="stable")
                    ends = [np.unique(z[order], return_index=True)[1] for z in (x, y)]
                    own = order[np.union1d(*ends)]
                    x, y = x[own], y[own]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[x], sid[y])), pa.array(np.maximum(sid[x], sid[y]))], names=["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = [b[c].to_numpy() for c in ("key", "n", "pos", "sid", "comp")]
        rows.append(np.frombuffer(b"".join(b["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH))
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        # the last key may go on in the next batch
        k = int(np.searchsorted(rows[0], rows[0][-1]))
        held = [x[k:].copy() for x in rows]
        if k:
            yield from pairs(*(x[:k] for x in rows))
    if held is not None:
        yield from pairs(*held)


def _thinned(pairs: DataFrame, sets: DataFrame, sketch: str) -> DataFrame:
    """The pairs a, b whose sizes and sketches allow the similarity."""

    def run(batches):
        for b in slices(batches, 1024):
            keep = [may_be_similar(*r) for r in zip(*(b[c].to_pylist() for c in ("nx", "ny", "x", "y")))]
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("sid").alias(c), F.col("n").alias(n), F.col(sketch).alias(w)) for c, n, w in (("a", "nx", "x"), ("b", "ny", "y")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "nx", "ny", "x", "y").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are similar enough, of those that their narrow sketches allow."""
    up, down = AT_LEAST.numerator, AT_LEAST.denominator

    def run(batches):
        for b in slices(batches):
            keep = []
            for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * down >= up * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = written(_thinned(pairs.distinct(), sets, "wide"))
    # only the sets that still are in a pair are fetched, once
    wanted = left.select(F.col("a").alias("sid")).unionAll(left.select(F.col("b").alias("sid"))).distinct()
    own = written(_shingled(texts.join(wanted, "sid")))
    one, two = (own.select(F.col("sid").alias(c), F.col("own").alias(o)) for c, o in (("a", "x"), ("b", "y")))
    out = cut(left.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    discard(own)
    discard(left)
    return out


def _further(tied: DataFrame, links: DataFrame) -> DataFrame:
    """node, component of all links together, where tied (node, component) are already known: only links between components count."""
    one, two = (tied.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("a", "b"))
    between = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b").distinct()
    more = written(components(between))
    roots = more.select(F.col("node").alias("component"), F.col("component").alias("root"))
    return tied.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")).unionAll(more)


def _tied(links: DataFrame) -> DataFrame:
    """node, component of links a < b: first those of each node's link to its smallest, one a node, then what is left between them."""
    hooks = links.groupBy("b").agg(F.min("a").alias("a"))
    return _further(written(components(hooks)), links)


def _most_shared(met: DataFrame) -> DataFrame:
    """key, f (n, sid of a set): under each key the set whose own keys have most rows in met (key, sid, n, many), so that near sets get the same."""
    popular = met.groupBy("sid").agg(F.sum("many").alias("popular"))
    return met.join(popular, "sid").groupBy("key").agg(F.max(F.struct("popular", "n", "sid")).alias("f"))


def _gathered(rows: DataFrame) -> DataFrame:
    """rows with all of a key in one partition, sorted by key, n and sid.

    Partitioned by a hash of key and not by key itself: where rows come from a join by key, Spark would see that partitioning
    as there already, drop this one and then read the join's shuffle by parts of a key, as mapInArrow asks for no partitioning.
    """
    return rows.repartition(F.xxhash64("key")).sortWithinPartitions("key", "n", "sid")


def _tried(met: DataFrame, tied: DataFrame, sets: DataFrame, best: bool) -> DataFrame:
    """a, b of one key in met that tied (node, component) leaves in different components and sketches allow: of each set's the likeliest, or all."""
    named = met.join(tied, met.sid == tied.node, "left").select("key", "n", "pos", "sid", F.coalesce("component", "sid").alias("comp"))
    split = named.groupBy("key").agg((F.min("comp") != F.max("comp")).alias("split")).where("split").select("key")
    left = named.join(split, "key").join(sets.select("sid", "sketch"), "sid").select("key", "n", "pos", "sid", "comp", "sketch")
    return _gathered(left).mapInArrow(lambda batches: _apart(batches, best), "a long, b long")


def similar_components(texts: DataFrame, proposed: DataFrame) -> DataFrame:
    """node, component over sid, text (each sid once): for each sid but the smallest of its component, that smallest.

    Sets are linked if their Jaccard similarity is AT_LEAST or more. proposed holds candidates a < b (of sids) that were
    found otherwise; they are confirmed in the first round and spare the others those that they tie. No rows: no rows.
    """
    sets = written(_sets(texts))
    prefixes = _prefixes(texts, *_common(texts))
    shared = prefixes.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    met = written(prefixes.join(shared, "key"))
    # the set under each shingle that is nearest to most with all others that it can be similar to by size
    fits = F.least("f.n", "n") * AT_LEAST.denominator >= F.greatest("f.n", "n") * AT_LEAST.numerator
    stars = met.join(_most_shared(met), "key").where((F.col("f.sid") != F.col("sid")) & fits).select(F.least("f.sid", "sid").alias("a"), F.greatest("f.sid", "sid").alias("b"))
    first = _confirmed(_thinned(stars.unionAll(proposed).distinct(), sets, "sketch"), sets, texts)
    tied = written(_tied(first))
    second = _confirmed(_tried(met, tied, sets, best=True), sets, texts)
    tied, before = written(_further(tied, second)), tied
    discard(before)
    third = _confirmed(_tried(met, tied, sets, best=False), sets, texts)
    discard(met)
    discard(sets)
    return _further(tied, third)
