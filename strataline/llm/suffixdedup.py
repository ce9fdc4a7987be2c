"""Repeated passages, by a prefix-free parse of the texts.

Triggers of a rolling hash over GRAM bytes cut each text into phrases: the trigger of a string of ``least`` bytes is the
smallest hash among those that start in its first REACH bytes, so that equal strings have the same trigger wherever they
stand. A phrase is the run of strings that share one trigger, with all their bytes; phrases overlap by ``least - 1``
bytes, so that the first ``least`` bytes of any suffix lie in one phrase. The dictionary holds every distinct phrase with
its first place in the corpus, the parse says which phrase stands where.

The parse is brought into the order (phrase, place): as phrases hold whole strings, its suffixes are needed to a depth of
one phrase only, and every place of a phrase but the first repeats the first. Of the dictionary, suffixes can begin with
equal strings only in phrases that agree from the trigger on. Such phrases are taken in pieces of SPLIT neighbouring
strings; pieces of equal bytes count once, and the suffixes of all distinct pieces that agree in what their strings share
are sorted, cut after ``least`` bytes, by ranges of bytes over the cluster. That is the dictionary's suffix array where
it can matter: equal strings are neighbours in it, compared byte by byte, and the first in place is the original.

Phrases are told apart by two 64-bit hashes, of the phrase and of its bytes from the trigger on: two unlike phrases of
equal bytes there are taken for one with a chance of 2^-64. Groupings are minima with partial sums and hot keys are joined
where they lie, so that a passage that a third of all documents hold doesn't meet in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, join_split, only, slices, whole_id, written

GRAM, REACH, SPLIT = 8, 64, 16
#: Positions whose triggers are sought in one array.
BLOCK = 1 << 16
#: Bytes of texts that are parsed in one array.
JOINED = 1 << 18
NO_ID = -(1 << 63)
_PLACE = ["d", "tie", "x"]


def phrases(raw: bytes, least: int, ends: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and trigger of each phrase of the texts that end at ends in raw (one text, unless given).

    A text of fewer than least bytes has none. A trigger lies within its string, so that what follows a text changes none of its phrases.
    """
    n = len(raw) - least + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    reach = min(REACH, least - GRAM + 1)
    grams = np.ndarray((n + reach - 1,), "<u8", raw, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams &= np.uint64(0xFFFFFFFF << 32)
    trigger = np.empty(n, np.int64)
    for a in range(0, n, BLOCK):
        # hash and place in one number; minima of windows from running minima of rows of reach numbers, forth and back
        part = grams[a : min(n, a + BLOCK) + reach - 1]
        many = len(part) - reach + 1
        both = np.full(-(-len(part) // reach) * reach, -1, np.int64).view(np.uint64)
        both[: len(part)] = part | np.arange(len(part), dtype=np.uint64)
        rows = both.reshape(-1, reach)
        forth, back = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least_of = np.minimum(back[:many], forth[reach - 1 : reach - 1 + many])
        trigger[a : a + many] = (least_of & np.uint64(0xFFFFFFFF)).astype(np.int64) + a
    own = np.ones(n, bool)
    for e in (ends or [])[:-1]:
        own[max(0, e - least + 1) : e] = False
    first = np.flatnonzero(np.r_[True, (trigger[1:] != trigger[:-1]) | (own[1:] != own[:-1])])
    last, own = np.r_[first[1:], n] - 1, own[first]
    return first[own], last[own], trigger[first[own]]


def _joined(batches):
    """Batches in runs of rows whose raw are JOINED bytes in all or one row: d, tie, the bytes in one and where each row's end."""
    for b in batches:
        ends = np.cumsum(pa.compute.binary_length(b["raw"]).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < b.num_rows:
            before = ends[a - 1] if a else 0
            z = max(a + 1, int(np.searchsorted(ends, before + JOINED, side="right")))
            rows = b.slice(a, z - a)
            yield rows["d"], rows["tie"], b"".join(rows["raw"].to_pylist()), (ends[a:z] - before)
            a = z


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _hashes(digests: list[bytes]) -> pa.Array:
    return pa.array(np.frombuffer(b"".join(digests), ">i8").astype(np.int64))


def _key(docs: DataFrame, id_col: str, text: Column, repeated: bool) -> list[Column]:
    """What names a text: its id, and a hash where ids repeat. A null id comes first."""
    tie = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    return [F.coalesce(whole_id(docs, id_col), F.lit(NO_ID)).alias("d"), tie.alias("tie")]


def _parse(texts: DataFrame, least: int) -> DataFrame:
    """The parse: key (hash of the bytes all strings of the phrase hold), e (hash of the phrase), its place d, tie, x, n strings, and the trigger t from x on."""
    core = least - min(REACH, least - GRAM + 1) + 1

    def run(batches):
        digest = xxhash.xxh3_64_digest
        only("suffixdedup")
        for d, tie, raw, ends in _joined(batches):
            first, last, at = phrases(raw, least, ends.tolist())
            of = np.searchsorted(ends, first, side="right")
            x = first - np.r_[0, ends][of]
            for a in range(0, len(first), BLOCK):
                cut = slice(a, a + BLOCK)
                f, z, t = first[cut], last[cut], at[cut]
                key = _hashes([digest(raw[i : i + core], 1) for i in t.tolist()])
                e = _hashes([digest(raw[i:j], 2) for i, j in zip(f.tolist(), (z + least).tolist())])
                rows = pa.array(of[cut])
                yield pa.RecordBatch.from_arrays(
                    [key, e, d.take(rows), tie.take(rows), pa.array(x[cut].astype(np.int32)), pa.array((z - f + 1).astype(np.int16)), pa.array((t - f).astype(np.int16))],
                    names=["key", "e", "d", "tie", "x", "n", "t"],
                )

    return texts.mapInArrow(run, "key long, e long, d long, tie long, x int, n short, t short")


def _pieces(texts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """Phrases in pieces of at most SPLIT strings by their distance from the trigger: core (hash of the bytes that all
    strings of such a piece hold), whole (hash of the piece), place, and the piece's bytes. Equal strings lie in pieces of equal core."""
    per_text = wanted.groupBy("d", "tie").agg(F.collect_list(F.struct("x", "n", "t")).alias("own"))

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        only("suffixdedup")
        for b in slices(batches):
            for d, tie, raw, own in zip(*(b[c].to_pylist() for c in ("d", "tie", "raw", "own"))):
                core, whole, place, held = [], [], [], []
                for p in own:
                    x, z, t = p["x"], p["x"] + p["n"], p["x"] + p["t"]
                    for k in range((t - z + 1) // SPLIT, (t - x) // SPLIT + 1):  # starts from t - k SPLIT - SPLIT + 1 to t - k SPLIT
                        a, e = max(x, t - (k + 1) * SPLIT + 1), min(z, t - k * SPLIT + 1)
                        core.append(digest(raw[t - k * SPLIT : t - (k + 1) * SPLIT + 1 + least], k))
                        place.append(a)
                        held.append(raw[a : e + least - 1])
                        whole.append(digest(held[-1], 5))
                n = len(core)
                yield pa.RecordBatch.from_arrays([_signed(core), _signed(whole), pa.array([d] * n, pa.int64()), pa.array([tie] * n, pa.int64()), pa.array(place, pa.int32()), pa.array(held, pa.binary())], names=["core", "whole", *_PLACE, "held"])

    return texts.join(per_text, ["d", "tie"]).select("d", "tie", "raw", "own").mapInArrow(run, "core long, whole long, d long, tie long, x int, held binary")


def _suffixes(pieces: DataFrame, least: int) -> DataFrame:
    """s (the first least bytes) and place of every suffix of the pieces."""

    def run(batches):
        for b in slices(batches, 1024):
            held, x = b["held"].to_pylist(), b["x"].to_numpy()
            many = np.array([len(raw) - least + 1 for raw in held], np.int64)
            of = np.repeat(np.arange(len(held)), many)
            start = x[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array([raw[k : k + least] for raw, n in zip(held, many.tolist()) for k in range(n)], pa.binary()), b["d"].take(at), b["tie"].take(at), pa.array(start.astype(np.int32))], names=["s", *_PLACE])

    return pieces.select("d", "tie", "x", "held").mapInArrow(run, "s binary, d long, tie long, x int")


def _after_an_equal(batches):
    """The places of rows sorted by s and place whose s the row before has too."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        own = b["s"].to_pylist()
        again = [u == v for u, v in zip([last, *own], own)]
        last = own[-1]
        yield b.select(_PLACE).filter(pa.array(again))


def _later(rows: DataFrame, by: list[str], total: int) -> DataFrame:
    """The rows that aren't the first in place of those equal in by."""
    first = rows.groupBy(*by).agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("many")).where("many > 1")
    return join_split(rows, first, by, "many", total).where(F.struct(*_PLACE) != F.col("first"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): each row of docs with its name d, tie and bytes raw; and d, tie with removed runs as array<struct<s, e>>.

    A run is a maximal stretch of bytes covered by strings of least bytes that start earlier too (smaller id, or the
    same text further left). Rows of one id with different texts are ordered by a hash of the text; rows that repeat
    id and text count as one text, and each gets its runs.
    """
    if least < GRAM:
        raise ValueError(f"least must be {GRAM} or more")
    repeated = not docs.groupBy(id_col).count().where("count > 1").isEmpty()
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key(docs, id_col, text, repeated), text.cast("binary").alias("raw"))
    texts = named.select("d", "tie", "raw")
    texts = texts.dropDuplicates(["d", "tie"]) if repeated else texts
    parse = written(_parse(texts, least))
    n = parse.count()
    # phrases that agree from the trigger on, by that key
    shared = parse.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    met = written(join_split(parse, shared, ["key"], "many", n).drop("many"))
    discard(parse)
    dictionary = written(met.groupBy("key", "e").agg(F.min(F.struct(*_PLACE, "n", "t")).alias("p"), F.count("*").alias("many")))
    first = dictionary.where("many > 1").select("key", "e", F.struct(*[f"p.{c}" for c in _PLACE]).alias("first"), "many")
    again = written(join_split(met, first, ["key", "e"], "many", n).where(F.struct(*_PLACE) != F.col("first")).select("d", "tie", "x", "n"))
    discard(met)
    contested = dictionary.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    firsts = join_split(dictionary.select("key", "p"), contested, ["key"], "many", n).select("p.*")
    pieces = written(_pieces(texts, firsts, least))
    discard(dictionary)
    m = pieces.count()
    # pieces that agree in what their strings share: equal ones count once, the suffixes of the others are sorted
    alike = pieces.groupBy("core").agg(F.count("*").alias("many"), (F.min("whole") != F.max("whole")).alias("contested")).where("many > 1")
    meet = join_split(pieces, alike, ["core"], "many", m).drop("many")
    whole = _later(meet, ["core", "whole"], m).select("d", "tie", "x", (F.length("held") - (least - 1)).cast("short").alias("n"))
    distinct = meet.where("contested").groupBy("core", "whole").agg(F.min(F.struct(*_PLACE, "held")).alias("p")).select("p.*")
    distinct = written(distinct)
    ordered = _suffixes(distinct, least).repartitionByRange("s").sortWithinPartitions("s", *_PLACE)
    moved = written(whole.unionAll(ordered.mapInArrow(_after_an_equal, "d long, tie long, x int").select("d", "tie", "x", F.lit(1).cast("short").alias("n"))))
    discard(distinct)
    discard(pieces)
    runs = again.unionAll(moved)

    def merged(group: pa.Table) -> pa.Table:
        s = np.sort(group["x"].to_numpy() * (1 << 20) + group["n"].to_numpy())
        s, e = s >> 20, (s >> 20) + (s & ((1 << 20) - 1)) - 1 + least
        e = np.maximum.accumulate(e)
        new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
        ends = e[np.r_[new[1:] - 1, len(e) - 1]]
        spans = [{"s": int(a), "e": int(z)} for a, z in zip(s[new], ends)]
        return pa.table({"d": group["d"][:1], "tie": group["tie"][:1], "spans": pa.array([spans], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))})

    spans = runs.select("d", "tie", F.col("x").cast("long").alias("x"), F.col("n").cast("long").alias("n")).groupBy("d", "tie").applyInArrow(merged, "d long, tie long, spans array<struct<s:long,e:long>>")
    return named, spans


def _kept(raw: bytes, spans: list[dict] | None) -> bytes:
    out, at = [], 0
    for p in spans or ():
        out.append(raw[at : p["s"]])
        at = p["e"]
    return b"".join([*out, raw[at:]])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 100) -> DataFrame:
    """docs with every repeated run cut out of the text (and n_chars, where there is one, counted anew).

    Bytes of a character that a run's edge splits go too. Null texts stay null, empty ones empty; no rows give no rows.
    Other columns pass through.
    """
    named, spans = repeated_spans(docs, id_col, text_col, least)
    text_type = docs.schema[text_col].dataType

    def run(batches):
        for b in slices(batches):
            kept = [_kept(r, s).decode("utf-8", "ignore") if s else None for r, s in zip(b["raw"].to_pylist(), b["spans"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(kept, pa.string())], names=["row", "kept"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("kept", T.StringType())])
    out = named.join(spans, ["d", "tie"], "left").select("row", "raw", "spans").mapInArrow(run, schema)
    text = F.coalesce("kept", F.col("row")[text_col]).cast(text_type)
    cols = {c: F.col("row")[c] for c in docs.columns} | {text_col: text}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(cols["n_chars"])
    return out.select(*[c.alias(n) for n, c in cols.items()])


def repeats_digest(docs: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs; null text counts as empty."""
    named, spans = repeated_spans(docs.select("doc_id", "text"), "doc_id", "text", least)

    def run(batches):
        for b in slices(batches):
            rows = list(zip(b["raw"].to_pylist(), b["spans"].to_pylist()))
            gone = [sum(p["e"] - p["s"] for p in s or ()) for _, s in rows]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([len(r) for r, _ in rows], pa.int64()), pa.array(gone, pa.int64()), pa.array([len(s or ()) for _, s in rows], pa.int64()), pa.array([hashlib.sha256(_kept(r, s)).hexdigest() for r, s in rows], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows = named.join(spans, ["d", "tie"], "left").select(F.col("row.doc_id").alias("doc_id"), "raw", "spans")
    return rows.mapInArrow(run, T.StructType([docs.schema["doc_id"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string"))
