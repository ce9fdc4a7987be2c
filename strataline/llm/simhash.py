"""SimHash fingerprints, and the documents whose fingerprints differ in few bits, by the general pigeonhole principle.

Bits that are set together are grouped into partitions. Thresholds per partition add up to the allowed distance less
the number of partitions plus one, so that any two fingerprints within the distance agree on some partition up to that
partition's threshold; a threshold of -1 leaves a partition out. A dynamic program picks the thresholds (and the
number of partitions) of the least estimated work: probes plus candidates. Every fingerprint is then put under its
partitions' values and their neighbours up to the threshold; those that meet are verified.

Only distinct fingerprints take part; documents follow theirs. Those that meet under one value are linked into a
forest there, so that a cluster yields as many rows as it has members. Values under which very many meet are first
split by the bits outside the partition, by the same principle.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nearcopies
from .common import cut, discard, fresh, others, slices, whole_id, written
from .components import Forest, components

#: A value under which more distinct fingerprints meet is split further.
CROWD = 512


def fingerprint(text: bytes, words_each: int = 3) -> int:
    """64 bits: each set if it is set in over half of the hashes of all shingles of so many words, repeats included."""
    words = text.lower().split()  # for bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    if len(words) <= words_each:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_digest  # big-endian
    raw = b"".join([digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[words_each - 1 :])])
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(rows), 8192):
        ones += np.unpackbits(rows[a : a + 8192], axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(rows))
    return int.from_bytes(bits.tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", words_each: int = 3) -> DataFrame:
    """docs with a long column out_col (the 64 bits as a signed number). Null or empty text, and text without words: 0."""

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t or b"", words_each) for t in b[b.schema.names[-1]].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], names=[*b.schema.names[:-1], out_col])

    (raw,) = fresh(docs, "text_bytes")
    kept = others(docs, out_col)
    schema = docs.select(*kept).schema.add(out_col, "long")
    return docs.select(*kept, F.col(text_col).cast("binary").alias(raw)).mapInArrow(run, schema)


def bit_counts(fps: DataFrame) -> np.ndarray:
    """For all pairs of bits the number of fingerprints with both set (64 x 64 numbers, summed by Spark)."""

    def partial(batches):
        total = np.zeros((64, 64))
        for b in batches:
            bits = np.unpackbits(b["fp"].to_numpy().view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel())], names=["i", "x"])

    out = np.zeros(4096)
    for r in fps.select("fp").mapInArrow(partial, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out.reshape(64, 64)


def grouped_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The 64 bits in partitions of near-equal size, each grown by the bit most correlated with those it holds."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    left, out = set(range(64)), []
    for k in range(parts):
        size = math.ceil(len(left) / (parts - k))
        own = [max(left, key=lambda b: (corr[b, list(left)].sum(), -b))]
        left.discard(own[0])
        while len(own) < size:
            nxt = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(nxt)
            left.discard(nxt)
        out.append(sorted(own))
    return out


def thresholds(both: np.ndarray, n: int, distance: int) -> tuple[list[list[int]], list[int]]:
    """The partitions and their thresholds of least estimated work per fingerprint."""
    p = np.diag(both) / n
    differ = 2 * p * (1 - p)
    best = None
    for parts in range(1, 2 * distance + 2):
        groups = grouped_bits(both, n, parts)
        cost = []
        for g in groups:
            at = np.array([1.0])  # the chances that two fingerprints differ in 0, 1, ... bits of the group
            for b in g:
                at = np.convolve(at, [1 - differ[b], differ[b]])
            probes = np.cumsum([math.comb(len(g), e) for e in range(distance + 1)])
            cost.append([0.0, *(probes[e] + n * at[: e + 1].sum() for e in range(distance + 1))])
        # over the groups so far: the least cost by the sum of thresholds + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            table = {s: min((v[0] + c[s - t], v[1] + [s - t - 1]) for t, v in table.items() if 0 <= s - t <= distance + 1) for s in range(distance + 2) if any(0 <= s - t <= distance + 1 for t in table)}
        value, taus = table[distance + 1]
        if best is None or value < best[0]:
            best = (value, groups, taus)
    return best[1], best[2]


def _mask(bits: list[int]) -> int:
    """A signed mask of bits counted from the highest."""
    m = sum(1 << (63 - b) for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _neighbours(fp: Column, bits: list[int], reach: int) -> Column:
    """The values of fp on bits, and all within reach of them."""
    flips = [_mask(list(c)) for e in range(reach + 1) for c in itertools.combinations(bits, e)]
    value = fp.bitwiseAND(F.lit(_mask(bits)))
    return F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: value.bitwiseXOR(x))


def _met(batches, distance: int):
    """Rows sorted by (part, key): a forest of those of one key within the distance, as rows fp, root."""
    held = None

    def forest(part, key, fp):
        n = len(fp)
        f, lag = Forest(n), 1
        rows = np.arange(n - 1)
        while len(rows):
            rows = rows[rows + lag < n]
            rows = rows[(key[rows] == key[rows + lag]) & (part[rows] == part[rows + lag])]
            x = fp[rows].view(np.uint64) ^ fp[rows + lag].view(np.uint64)
            close = rows[np.bitwise_count(x) <= distance]
            if len(close):
                f.link(close, close + lag)
            lag += 1
        tied = np.flatnonzero(f.root != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[f.root[tied]])], names=["fp", "root"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = [np.asarray(b[c]) for c in ("part", "key", "fp")]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        # the last key may go on in the next batch
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        n = int(np.argmax(last))
        held = [x[n:].copy() for x in rows]
        if n:
            yield forest(*(x[:n] for x in rows))
    if held is not None:
        yield forest(*held)


def fingerprint_links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join all within the distance of each other.

    Not every such pair is a row: one that is connected by others isn't. An empty table gives no rows.
    """
    n = fps.count()
    both = bit_counts(fps)
    groups, taus = thresholds(both, max(n, 1), distance)
    used = [(g, t) for g, t in zip(groups, taus) if t >= 0]
    keys = [_tagged(_neighbours(F.col("fp"), g, t), i) for i, (g, t) in enumerate(used)]
    put = fps.select("fp", F.explode(F.concat(*keys)).alias("k")).select("k.part", "k.key", "fp")
    # under a crowded value two can still differ in so many bits: of one part more of the other bits they agree on one
    crowded = put.groupBy("part", "key").count().where(F.col("count") > CROWD).select("part", "key", F.lit(True).alias("crowded"))
    put = put.join(crowded, ["part", "key"], "left")
    split = []
    for i, (g, _) in enumerate(used):
        others = [b for b in range(64) if b not in g]
        pieces = [others[j :: distance + 1] for j in range(distance + 1)]
        split.append(F.array(*[F.struct(F.lit((i + 1) * 100 + j).alias("part"), F.xxhash64(F.col("key"), F.col("fp").bitwiseAND(F.lit(_mask(x)))).alias("key")) for j, x in enumerate(pieces)]))
    pick = F.element_at(F.array(*split), F.col("part") + 1)
    fine = put.where("crowded").select(F.explode(pick).alias("k"), "fp").select("k.part", "k.key", "fp")
    dealt = put.where("crowded is null").select("part", "key", "fp").unionAll(fine)
    dealt = dealt.repartition("part", "key").sortWithinPartitions("part", "key", "fp")
    return dealt.mapInArrow(lambda batches: _met(batches, distance), "fp long, root long").select(F.col("fp").alias("a"), F.col("root").alias("b"))


def _tagged(values: Column, part: int) -> Column:
    return F.transform(values, lambda k: F.struct(F.lit(part).alias("part"), k.alias("key")))


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, words_each: int = 3) -> DataFrame:
    """id_col, fingerprint (long), component_id: the smallest id reachable by links of at most so many bits.

    Texts without words (null too) have fingerprint 0, which links like any other. Repeated rows and ids share their
    fingerprint's component. No rows: no rows.
    """
    marked = cut(with_fingerprint(docs.select(whole_id(docs, id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp", words_each).select("id", "fp"))
    fps = cut(marked.groupBy("fp").agg(F.min("id").alias("rep")))
    links = components(fingerprint_links(fps.select("fp"), distance))
    # a component's name is its smallest document, not its smallest fingerprint
    named = fps.join(links, fps.fp == links.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def proposed_pairs(texts: DataFrame, distance: int = 3) -> DataFrame:
    """a < b over sid, text: links of sids whose fingerprints of five-word shingles differ in few bits, not all pairs of a group."""
    marked = written(with_fingerprint(texts.select("sid", "text"), "text", "fp", nearcopies.WORDS_EACH).select("sid", "fp"))
    fps = written(marked.groupBy("fp").agg(F.min("sid").alias("rep")))
    same = marked.join(fps, "fp").where("sid <> rep").select(F.col("rep").alias("a"), F.col("sid").alias("b"))
    near = fingerprint_links(fps.select("fp"), distance).distinct()
    one, two = (fps.select(F.col("fp").alias(c), F.col("rep").alias(r)) for c, r in (("a", "x"), ("b", "y")))
    return same.unionAll(near.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id, nulls last, then by a hash of the text.

    A group is a component of texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles. Fingerprints
    of these shingles propose most links; those further apart are found exactly too, and all are confirmed (see nearcopies). Rows that repeat an id, or that have none, are rows like any other: of each group exactly
    one stays. Texts without words (null too) are copies of each other.
    """
    row, sid, first = fresh(docs, "row_number", "set_name", "first_place")
    marked = written(nearcopies.with_set(docs, text_col, sid).withColumn(row, F.monotonically_increasing_id()))
    place = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(F.col(text_col)), F.col(row).alias("row"))
    least = marked.groupBy(F.col(sid).alias("sid")).agg(F.min(place).alias(first))
    # of texts of one set only the first can stay; the others are done with
    kept = written(marked.join(least.select(first, F.col(f"{first}.row").alias(row)), row))
    discard(marked)
    texts = kept.select(F.col(sid).alias("sid"), F.col(text_col).alias("text"))
    tied = nearcopies.similar_components(texts, proposed_pairs(texts))
    groups = kept.select(F.col(sid).alias("sid"), F.col(first).alias("first")).join(tied, F.col("sid") == F.col("node"), "left").groupBy(F.coalesce("component", "sid")).agg(F.min("first").alias("first"))
    return kept.join(groups.select(F.col("first.row").alias(row)), row, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def simhash_digest(docs: DataFrame) -> DataFrame:
    return near_documents(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
