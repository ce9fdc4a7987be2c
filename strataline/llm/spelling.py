"""Words grouped with their spelling variants, without forming pairs of words.

Each word leaves one row for every position with that letter replaced by a wildcard, one for every string that comes of
deleting one letter, and one of its own. Rows meet by string. Words under one wildcard are each other's replacements: the
group's size and its first two words say for each of them how many near words it gains there and which of them is the
most frequent. A deletion that meets a word's own row tells both of them of each other. Sums and minima by word of what
its rows have seen then give its near words, and following the most frequent one gives its root.

Rows hold fixed-size fingerprints and numbers instead of strings, so that a run of n letters costs memory in n, not n * n.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, written
from .learn import lowered

#: Letters are A to Z, a to z and U+00C0 to U+00FF; capitals are gone when this is looked for.
RUN = re.compile("[a-zÀ-ÿ]+")
#: One run in so many, by a hash of its document and itself, loses a letter.
SPOIL = 97
#: Distinct words a task counts before it passes its counts on, and code points fingerprinted at once.
COUNTED, AT_ONCE = 400_000, 1 << 20
#: Fingerprints are polynomials modulo four primes below 2^31 (each with a base of its own): unlike strings of n letters
#: agree in all four with a chance of at most (n / 2^31)^4.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1093782611, 721583263, 1686301849, 394187587)
WILDCARD = 1
OWN, DELETED, REPLACED = 0, 1, 2


def runs(doc_id, text: str, spoil: int = SPOIL) -> Counter:
    """The runs of letters of a text with how often each stands there, some with a letter less."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(lowered(text).decode())).items():
        h = zlib.crc32(run.encode(), seed)
        if h % spoil == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, spoil: int = SPOIL) -> DataFrame:
    """word, n: the runs of at least shortest code points that stand at least least times in all texts.

    Null texts have none; a null id counts as an empty one. Repeated rows count as often as they stand.
    """

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for i in range(b.num_rows):
                text = b["text"][i].as_py()
                if text:
                    for run, n in runs(b["id"][i].as_py(), text, spoil).items():
                        if len(run) >= shortest:
                            seen[run] += n
                    if len(seen) > COUNTED:
                        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
                        seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _powers(base: int, p: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.int64)
    have, step = 1, base % p
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step % p
        have, step = have + take, step * step % p
    return out


def fingerprints(words: list[str]) -> tuple[np.ndarray, ...]:
    """(row of its word, kind, first and second key) of every word's own row, its deletions and its wildcards.

    Of equal neighbouring letters only the first is deleted, as the others leave the same string.
    """
    c = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    start = end - size
    row = np.repeat(np.arange(len(words)), size)
    pos = np.arange(len(c)) - start[row]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (pos[1:] == 0)
    parts = []
    for p, base in zip(PRIMES, BASES):
        at = _powers(base, p, int(size.max(initial=0)))[pos]
        term = c * at % p
        sums = np.concatenate([[0], np.cumsum(term)])
        whole = sums[end] - sums[start]
        before = sums[:-1] - sums[start][row]
        after = (whole[row] - before - term) % p
        deleted = (before + after * pow(base, -1, p)) % p
        replaced = (whole[row] - term + WILDCARD * at) % p
        parts.append(np.concatenate([whole % p, deleted[new], replaced]))
    kind = np.repeat([OWN, DELETED, REPLACED], [len(words), int(new.sum()), len(c)])
    return np.concatenate([np.arange(len(words)), row[new], row]), kind, parts[0] << 31 | parts[1], parts[2] << 31 | parts[3]


def _keys(batches):
    for b in batches:
        words, wid, n = b["word"].to_pylist(), b["wid"].to_numpy(), b["n"].to_numpy()
        edges = np.cumsum([len(w) for w in words]) // AT_ONCE
        for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(edges)) + 1):
            if len(part):
                row, kind, k1, k2 = fingerprints([words[i] for i in part])
                cols = [pa.array(x) for x in (k1, k2, kind.astype(np.int32), wid[part][row], n[part][row])]
                yield pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "kind", "wid", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """wid, n_near, best_n, best: of each row (word, n, wid) the number of words one edit away and the most frequent of them.

    Of equally frequent ones the smallest wid counts. Words without a near one have no row. A group of rows that meet is
    bounded by the alphabet (one letter replaced) or the alphabet times the word's length (one inserted), never by the
    table's size.
    """
    rows = words.mapInArrow(_keys, "k1 long, k2 long, kind int, wid long, n long")
    meet = Window.partitionBy("k1", "k2")
    order = meet.orderBy("kind", F.desc("n"), "wid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct("kind", "n", "wid")
    seen = rows.select("kind", "wid", F.count("*").over(meet).alias("size"), F.first(me).over(order).alias("a"), F.nth_value(me, 2).over(order).alias("b")).where("size > 1")
    # a deletion tells of its own row's word only, which stands first; else all rows but one's own count
    useful = seen.where((F.col("kind") != DELETED) | (F.col("a.kind") == OWN))
    gained = F.when(F.col("kind") == DELETED, 1).otherwise(F.col("size") - 1)
    other: Column = F.when((F.col("a.wid") == F.col("wid")) & (F.col("a.kind") == F.col("kind")), F.col("b")).otherwise(F.col("a"))
    out = useful.select("wid", gained.alias("gained"), other.alias("o")).groupBy("wid")
    out = out.agg(F.sum("gained").alias("n_near"), F.min(F.struct((-F.col("o.n")).alias("m"), F.col("o.wid").alias("best"))).alias("x"))
    return out.select("wid", "n_near", (-F.col("x.m")).alias("best_n"), F.col("x.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """wid, root: where following (wid, form) ends, by pointers that double their reach each round.

    Counts at least double along a form, so that the longest chain is short and a few rounds end it.
    """
    up = written(links.select("wid", F.col("form").alias("root")))
    while True:
        on = up.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        further = written(up.join(on, "root", "left").select("wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(up)
        up = further
        if up.where("moved").isEmpty():
            return up.select("wid", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, ratio: int = 2, spoil: int = SPOIL) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word with its most frequent near word and where following those ends.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of the largest n
    (ties: the smallest in code-point order) if that is at least ratio times the word's own, else null; the root is the
    word itself without a form. Null and empty texts have no words; no words: no rows. Other columns are ignored.
    """
    counted = vocabulary(docs, id_col, text_col, shortest, least, spoil)
    # after a sort the ids grow with the word, so that they stand for it where ties are broken
    words = written(counted.orderBy("word").select("word", "n", F.monotonically_increasing_id().alias("wid")))
    near = written(near_words(words))
    links = words.select("wid", "n").join(near, "wid").where(F.col("best_n") >= ratio * F.col("n")).select("wid", F.col("best").alias("form"), F.col("best_n").alias("form_n"))
    called = lambda name: words.select(F.col("wid").alias(f"{name}_id"), F.col("word").alias(name))
    ends = links.join(roots(links).withColumnRenamed("root", "root_id"), "wid").withColumnRenamed("form", "form_id")
    named = ends.join(called("form"), "form_id").join(called("root"), "root_id").select("wid", "form", "root", "form_n")
    out = words.join(near.select("wid", "n_near"), "wid", "left").join(named, "wid", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
