"""Packing documents into training sequences by cutting-stock column generation.

A document's ids are cut into whole sequences, a body of whole units (UNIT ids) and a tail shorter than a unit. Bodies
are items of 1 to length/UNIT units, tails items of 1 to UNIT-1 ids; their histograms (a few hundred numbers) go to
the driver. There a linear program over patterns (how many items of each size one sequence takes) is solved by the
revised simplex method, each new pattern priced by a knapsack dynamic program; solutions are rounded down and the
items left over are placed by first fit decreasing. Items of one size are ranked over the whole corpus and a rank
decides the pattern, the sequence and the offset, so that every row finds its place by itself.
"""

from __future__ import annotations

import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, only, slices

UNIT = 16
#: Words, and runs within words, whose ids a generation of a Python worker remembers.
REMEMBERED = 250_000
#: White space to Python's split, but not to tokenizers.
SEPARATORS = "\x1c\x1d\x1e\x1f"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def best_pattern(value: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """The counts of items of the highest value in room: an unbounded knapsack by dynamic programming."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(size, kind="stable")
    value, size_up = value[order], size[order]
    for c in range(1, room + 1):
        fits = int(np.searchsorted(size_up, c, side="right"))
        best[c] = best[c - 1]
        if fits:
            x = best[c - size_up[:fits]] + value[:fits]
            i = int(np.argmax(x))
            if x[i] > best[c] + 1e-12:
                best[c], last[c] = x[i], i
    out, c = np.zeros(len(size), np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[order[last[c]]] += 1
            c -= size_up[last[c]]
    return out


def generate_patterns(size: np.ndarray, demand: np.ndarray, room: int, slack: float = 2e-4, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, in a solution of the linear program for the least number of sequences.

    Columns are priced until the best one saves at most the share slack, which bounds the distance from the optimum.
    """
    m = len(size)
    if not m:
        return []
    columns = np.diag(room // size).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    for k in range(1, rounds + 1):
        prices = inverse.sum(axis=0)  # every sequence costs one
        new = best_pattern(prices, size, room)
        if prices @ new <= 1 + slack:
            break
        step = inverse @ new
        enter = step > 1e-9
        ratio = np.full(m, np.inf)
        ratio[enter] = x[enter] / step[enter]
        j = int(np.argmin(ratio))
        if not np.isfinite(ratio[j]):
            break
        columns[:, j] = new
        if k % 200:  # one pivot; now and then afresh, against rounding
            row = inverse[j] / step[j]
            inverse -= np.outer(step, row)
            inverse[j] = row
        else:
            inverse = np.linalg.inv(columns)
        x = np.maximum(inverse @ demand, 0)
    x = np.maximum(np.linalg.solve(columns, demand.astype(float)), 0)
    return [(columns[:, j].astype(np.int64), x[j]) for j in range(m) if x[j] > 1e-9]


def plan(size: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole numbers of uses that place every item: rounded down, then the rest by first fit decreasing."""
    left, out = demand.copy(), []
    for pattern, x in sorted(generate_patterns(size, demand, room), key=lambda p: (-p[1], tuple(p[0]))):
        taken = np.flatnonzero(pattern)
        n = int(min(np.floor(x + 1e-6), (left[taken] // pattern[taken]).min()))
        if n > 0:
            out.append((pattern, n))
            left = left - n * pattern
    bins: list[tuple[np.ndarray, int]] = []
    free = np.zeros(0, np.int64)
    for i in np.argsort(-size, kind="stable"):
        for _ in range(int(left[i])):
            at = np.flatnonzero(free >= size[i])
            if not len(at):
                free = np.append(free, room)
                bins.append((np.zeros(len(size), np.int64), 1))
                at = [len(free) - 1]
            free[at[0]] -= size[i]
            bins[at[0]][0][i] += 1
    return out + bins


def placements(kinds: np.ndarray, demand: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Rows kind, first rank, items of it in a sequence, first sequence, first offset: of bounded number.

    kinds are item lengths in ids: multiples of UNIT (bodies and whole sequences) or shorter than one (tails).
    """
    rows, base = [], 0
    seen = {int(k): 0 for k in kinds}
    for own, unit in ((kinds >= UNIT, UNIT), (kinds < UNIT, 1)):
        size = kinds[own] // unit
        for pattern, n in plan(size, demand[own], length // unit):
            at = 0
            for i in np.flatnonzero(pattern)[::-1]:
                k = int(kinds[own][i])
                rows.append((k, seen[k], int(pattern[i]), base, at))
                seen[k] += n * int(pattern[i])
                at += k * int(pattern[i])
            base += n
    rows.sort()
    return dict(zip(("kind", "rank", "each", "sequence", "at"), np.array(rows, np.int64).reshape(-1, 5).T))


class Recent:
    """A dictionary that keeps what was used lately: a full generation becomes the old one, whose entries return when used."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those of keys that aren't known; all others are in the present generation afterwards."""
        need = keys.difference(self.new)
        if len(self.new) + len(need) > self.most:
            self.old, self.new = self.new, {}
            need = keys
        out = need.difference(self.old)
        for k in need.difference(out) if len(out) < len(need) else ():
            self.new[k] = self.old[k]
        return list(out)


#: Words of printable ASCII without an apostrophe and of Latin-1 letters: the tokenizer lower-cases them and reads runs of
#: letters, single digits and runs of other signs apart, so that these pieces can be looked up by themselves.
_PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_RUNS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: The signs that stand for bytes in the tokenizer's pieces, where they aren't the code points of the same number.
_BYTES = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}


class Ids:
    """Little-endian unsigned 32-bit ids of texts, white space apart, by word: the tokenizer's words never cross it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merged = self.tokenizer.model.tokenize  # of one piece, as the normalizer and the splits leave it
        self.words, self.runs = Recent(REMEMBERED), Recent(REMEMBERED)

    @staticmethod
    def _each(tokenizer, words: list[str]):
        """The ids of each word, many words in one call."""
        for a in range(0, len(words), 512):
            part = words[a : a + 512]
            got = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(got.ids, "<u4").tobytes()
            ends = (np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(part) + 1)) * 4).tolist()
            yield from (raw[i:j] for i, j in zip(ends, ends[1:]))

    def _piece(self, piece: str) -> bytes:
        piece = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
        ids = [t.id for t in self.merged(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        words = text.split() if not any(c in text for c in SEPARATORS) else re.split(r"[^\S\x1c-\x1f]+", text)
        if missing := self.words.missing(set(words)):
            plain, other = [], []
            for w in missing:
                if w.isalpha() and w.isascii():  # one run
                    self.words.new[w] = self._piece(w.lower())
                elif _PLAIN.fullmatch(w):
                    plain.append((w, _RUNS.findall(w.lower())))
                else:
                    other.append(w)
            for r in self.runs.missing({r for _, own in plain for r in own}):
                self.runs.new[r] = self._piece(r)
            self.words.new.update((w, b"".join(map(self.runs.new.__getitem__, own))) for w, own in plain)
            self.words.new.update(zip(other, self._each(self.tokenizer, other)))
        return b"".join(map(self.words.new.__getitem__, words))


_OPEN: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """The worker's own Ids: what its earlier tasks have met stays known."""
    only("packing", _OPEN)
    if path not in _OPEN:
        _OPEN[path] = Ids(path)
    return _OPEN[path]


def pieces(docs: DataFrame, tokenizer_path: str, length: int, end_id: int) -> DataFrame:
    """One row per piece of each document (doc_id, text): whole sequences, a body of units, a tail."""

    def run(batches):
        ids = ids_of(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for b in slices(batches):
            out = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                raw = ids.encode(text or "") + end
                n = len(raw) // 4
                body = n % length // UNIT * UNIT
                sizes = chain((length for _ in range(n // length)), (s for s in (body, n % length - body) if s))
                start = 0
                for s in sizes:
                    out.append((doc, start, s, zlib.crc32(raw[start * 4 : (start + s) * 4]), n))
                    start += s
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: each id of each document in exactly one piece.

    A document is its text's ids and end_id; null text counts as empty (one id). Pieces of a sequence lie without gaps
    from offset 0. Repeated rows are packed one by one. No documents: no rows. Other columns are ignored. length must
    be a multiple of UNIT.
    """
    if length % UNIT:
        raise ValueError(f"length must be a multiple of {UNIT}")
    cutup = cut(pieces(docs.select(F.col("doc_id").cast("long"), "text"), tokenizer_path, length, end_id))
    cutup = cutup.withColumn("part", F.spark_partition_id())
    counts = cutup.groupBy("part", "length").agg(F.count("*").alias("n"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    kinds = np.array(sorted(total), np.int64)
    plan_rows = placements(kinds, np.array([total[int(k)] for k in kinds], np.int64), length)
    # the rank of an item among those of its length: those of earlier partitions, then those before it in its own
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def local_ranks(batches):
        seen = np.zeros(length + 1, np.int64)
        for b in batches:
            kind = b["length"].to_numpy()
            order = np.argsort(kind, kind="stable")
            run = kind[order]
            first = np.searchsorted(run, run)
            rank = np.empty(len(kind), np.int64)
            rank[order] = np.arange(len(kind)) - first + seen[run]
            seen += np.bincount(kind, minlength=length + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank)], names=[*b.schema.names, "local"])

    def place(batches):
        start = plan_rows["kind"] * (1 << 40) + plan_rows["rank"]
        for b in batches:
            kind, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            at = np.searchsorted(start, kind * (1 << 40) + rank, side="right") - 1
            nth = rank - plan_rows["rank"][at]
            each = plan_rows["each"][at]
            sequence = plan_rows["sequence"][at] + nth // each
            offset = plan_rows["at"][at] + nth % each * kind
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    ranked = cutup.mapInArrow(local_ranks, f"{_PIECE}, part int, local long").join(before, ["part", "length"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(place, f"{_PIECE}, sequence_id long, offset long")
