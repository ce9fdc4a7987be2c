"""Byte-level BPE by recursive queries.

Each task splits its texts into words by the tokenizer's pattern and hands the words it hasn't met before to a DuckDB
of its own: rows of word, position and token join the table of merges and each word's leftmost pair of the lowest rank
is contracted, again and again until no pair is left. Grouping by word with ordered aggregation then gives a word's
ids, and from the ids' bytes its decoded text. Words are kept for later texts of the task up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, only, others

#: Words that are looked at together, and words that a Python worker remembers.
WORDS_AT_ONCE, REMEMBERED = 250_000, 500_000
#: Words of more bytes contract all pairs of the lowest rank in one round where no merge can come between them.
LONG = 200

#: A word's tokens stand in a list between rounds; a round lays them out as rows, joins and contracts one pair.
ONE_PAIR = """
WITH RECURSIVE state(word, toks, done) AS (
  SELECT word, toks, false FROM start_lists
  UNION ALL
  (WITH best AS (
     SELECT p.word, min(m.merged * 1048576 + p.pos) AS least FROM (
       SELECT word, unnest(toks[:-2]) AS tok, unnest(toks[2:]) AS next, unnest(range(1, len(toks))) AS pos FROM state WHERE NOT done) p
     JOIN merges m ON m.pair = p.tok * 1048576 + p.next GROUP BY p.word)
   SELECT s.word, CASE WHEN b.word IS NULL THEN s.toks ELSE
            s.toks[:b.least % 1048576 - 1] || [b.least // 1048576] || s.toks[b.least % 1048576 + 2:] END, b.word IS NULL
   FROM state s LEFT JOIN best b ON b.word = s.word WHERE NOT s.done)),
fixed AS (SELECT word, array_to_string(toks, ',') AS ids, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM state WHERE done)
SELECT word, first(ids) AS ids, unhex(string_agg(t.hex, '' ORDER BY pos)) AS decoded FROM fixed JOIN tokens t ON t.id = fixed.tok GROUP BY word"""

#: The pairs of the lowest rank, of neighbours that overlap every other from the left; only the first where a new
#: pair could be of a lower rank still.
ALL_PAIRS = """
WITH RECURSIVE state(word, pos, tok, done) AS (
  SELECT word, pos, tok, false FROM start_rows
  UNION ALL
  (WITH pairs AS (
     SELECT s.word, s.pos, s.tok, m.merged FROM (
       SELECT word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS next FROM state WHERE NOT done) s
     LEFT JOIN merges m ON m.pair = s.tok * 1048576 + s.next),
   lowest AS (
     SELECT *, row_number() OVER (PARTITION BY word ORDER BY pos) AS nth, coalesce(merged = min(merged) OVER (PARTITION BY word), false) AS low,
            min(merged) OVER (PARTITION BY word) IS NULL AS done FROM pairs),
   counted AS (SELECT *, row_number() OVER (PARTITION BY word, low ORDER BY pos) AS nth_low FROM lowest),
   marked AS (
     SELECT word, pos, tok, merged, done,
            low AND CASE WHEN merged IN (SELECT merged FROM early) THEN nth_low = 1 ELSE (nth_low - min(nth_low) OVER (PARTITION BY word, low, nth - nth_low)) % 2 = 0 END AS chosen
     FROM counted)
   SELECT word, pos, CASE WHEN chosen THEN merged ELSE tok END, done FROM (
     SELECT *, coalesce(lag(chosen) OVER (PARTITION BY word ORDER BY pos), false) AS gone FROM marked) WHERE NOT gone))
SELECT word, string_agg(tok::VARCHAR, ',' ORDER BY pos) AS ids, unhex(string_agg(t.hex, '' ORDER BY pos)) AS decoded
FROM state JOIN tokens t ON t.id = state.tok WHERE done GROUP BY word"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Words:
    """ids and decoded bytes of words, from a DuckDB that holds the merges."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        pairs, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a * 1048576 + b)
                    merged.append(rank)
        db = self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        merges = pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int64())})  # noqa: F841
        tokens = pa.table({"id": pa.array(ranks.values(), pa.int64()), "hex": [t.hex() for t in ranks]})  # noqa: F841
        db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        db.execute("CREATE TABLE tokens AS SELECT * FROM tokens")
        # merged tokens that may merge on into one of a lower rank
        first, second, rank = np.array(pairs) // 1048576, np.array(pairs) % 1048576, np.array(merged)
        early = pa.table({"merged": np.unique(np.concatenate([first[rank < first], second[rank < second]]))})  # noqa: F841
        db.execute("CREATE TABLE early AS SELECT * FROM early")

    def learn(self, words: set[str]) -> None:
        """Makes ids and decoded hold these words; forgets others when there are too many."""
        if len(self.ids) + len(words) > REMEMBERED:
            self.ids = {w: x for w in words if (x := self.ids.get(w)) is not None}
            self.decoded = {w: self.decoded[w] for w in self.ids}
        new = [w for w in words if w not in self.ids]
        raw = [w.encode() for w in new]
        for rounds, which in ((ONE_PAIR, [i for i, r in enumerate(raw) if len(r) <= LONG]), (ALL_PAIRS, [i for i, r in enumerate(raw) if len(r) > LONG])):
            if not which:
                continue
            own = [raw[i] for i in which]
            size = np.array([len(r) for r in own])
            tok = self.bytes_to_id[np.frombuffer(b"".join(own), np.uint8)]
            pos = np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size)
            number = np.arange(len(own))
            start_rows = pa.table({"word": np.repeat(number, size), "pos": pos, "tok": tok})  # noqa: F841
            start_lists = pa.table({"word": number, "toks": pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), tok)})  # noqa: F841
            got = self.db.sql(rounds).to_arrow_table()
            for k, ids, dec in zip(got["word"].to_pylist(), got["ids"].to_pylist(), got["decoded"].to_pylist()):
                w = new[which[k]]
                self.ids[w], self.decoded[w] = ids, dec


_OPEN: dict[str, Words] = {}


def words_of(ranks_path: str) -> Words:
    """The worker's own Words: what its earlier tasks have learnt stays known."""
    only("bytebpe", _OPEN)
    if ranks_path not in _OPEN:
        _OPEN[ranks_path] = Words(read_ranks(ranks_path))
    return _OPEN[ranks_path]


def encoded(texts: list[str], words: Words, pattern) -> list[tuple[int, str, str]]:
    """n_tokens, SHA-256 of the ids joined by commas, SHA-256 of the decoded bytes, for each text."""
    state = [[0, hashlib.sha256(), hashlib.sha256()] for _ in texts]
    waiting: list[tuple[int, list[str]]] = []
    many = 0

    def settle() -> None:
        words.learn(set(itertools.chain.from_iterable(w for _, w in waiting)))
        for i, own in waiting:
            ids = ",".join(map(words.ids.__getitem__, own))
            s = state[i]
            s[1].update((("," if s[0] else "") + ids).encode())
            s[0] += ids.count(",") + 1
            s[2].update(b"".join(map(words.decoded.__getitem__, own)))
        waiting.clear()

    for i, text in enumerate(texts):
        found = pattern.finditer(text) if len(text) > 1 << 20 else iter(pattern.findall(text))
        while own := list(itertools.islice(found, WORDS_AT_ONCE)):
            if not isinstance(own[0], str):
                own = [m.group() for m in own]
            waiting.append((i, own))
            many += len(own)
            if many >= WORDS_AT_ONCE:
                settle()
                many = 0
    settle()
    return [(n, a.hexdigest(), b.hexdigest()) for n, a, b in state]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of each whole text; columns of these names are replaced.

    Null text counts as empty: no tokens, and the digests of nothing. ranks_path must be readable on every executor.
    """
    out = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    names = [f.name for f in out]
    kept = others(docs, *names)
    (raw,) = fresh(docs, "text_to_encode")

    def run(batches):
        import regex

        words, splitter = words_of(ranks_path), regex.compile(pattern)
        for b in batches:
            rows = encoded([t or "" for t in b.column(b.num_columns - 1).to_pylist()], words, splitter)
            cols = [pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], *names])

    schema = T.StructType([*docs.select(*kept).schema.fields, *out])
    return docs.select(*kept, F.col(text_col).alias(raw)).mapInArrow(run, schema)
