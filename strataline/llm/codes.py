"""Vector codes: each of a vector's parts is replaced by the number of the nearest of 256 entries of its codebook.

The nearest entry is found by annular norm pruning. Entries stand in the order of their norms; by the triangle
inequality an entry at distance d or less from a part has a norm within d of the part's. A few entries of about the
part's norm give a first d, two binary searches the interval of norms it allows, and all entries of that annulus, both
ends included, are compared exactly in integers. Codebooks learn by rounds over all vectors; each task sums what it
assigned, so that between rounds only sums by entry, whose number is fixed, are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_split, whole_id, written
from .topk import usable

#: Entries of about the same norm that give a part its first distance; parts that are searched together.
PILOTS, TOGETHER = 8, 256
#: Components beyond this would leave squared distances outside 64 bits.
LARGEST = 1 << 27


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each part, of integers; ties go to the lower index."""
    exact = np.float64 if 4 * max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0)) ** 2 * max(1, parts.shape[1]) < 1 << 53 else np.int64
    x, e = parts.astype(exact), entries.astype(exact)
    e_sq = (e * e).sum(axis=1)
    order = np.argsort(e_sq, kind="stable")
    e, e_sq, norms = e[order], e_sq[order], np.sqrt(e_sq[order].astype(np.float64))
    x_sq = (x * x).sum(axis=1)
    x_norm = np.sqrt(x_sq.astype(np.float64))
    where, best = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    by_norm = np.argsort(x_norm, kind="stable")
    for some in np.split(by_norm, range(TOGETHER, len(by_norm), TOGETHER)):
        a, na = x[some], x_norm[some]
        near = np.clip(np.searchsorted(norms, na)[:, None] + np.arange(-PILOTS // 2, PILOTS // 2), 0, len(e) - 1)
        tried = ((a[:, None, :] - e[near]) ** 2).sum(axis=2).min(axis=1)
        reach = np.sqrt(tried.astype(np.float64)) * (1 + 1e-9) + 1e-6  # wider than rounding can be
        lo, hi = np.searchsorted(norms, na - reach, "left"), np.searchsorted(norms, na + reach, "right")
        first, last = lo.min(), hi.max()
        d = x_sq[some][:, None] - 2 * (a @ e[first:last].T) + e_sq[first:last]
        at = np.arange(first, last)
        d[(at < lo[:, None]) | (at >= hi[:, None])] = d.max() + 1
        best[some] = least = d.min(axis=1)
        where[some] = np.where(d == least[:, None], order[first:last], len(e)).min(axis=1)
    return where, best


def integer_parts(vecs: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors of one length, a row each."""
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = np.floor(flat * scale).reshape(len(vecs), -1)
    if np.abs(m).max(initial=0) > LARGEST:
        raise OverflowError(f"a component beyond {LARGEST}: use a smaller scale")
    return m.astype(np.int64)


def _assigned(books: list[np.ndarray], scale: float, vecs: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    m = integer_parts(vecs, scale)
    return [(part, *nearest(part, book)) for part, book in zip(np.split(m, len(books), axis=1), books)]


def learnt_round(vecs: DataFrame, books: list[np.ndarray], scale: float) -> list[np.ndarray]:
    """The codebooks after all rows of v were assigned to them: each entry is the floor of its parts' mean, unused ones stay."""
    width = books[0].shape[1]

    def sums(batches):
        total = [np.zeros((len(b), width), np.int64) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for k, (part, at, _) in enumerate(_assigned(books, scale, batch["v"])):
                by = np.argsort(at, kind="stable")
                used, first = np.unique(at[by], return_index=True)
                total[k][used] += np.add.reduceat(part[by], first, axis=0)
                count[k] += np.bincount(at, minlength=len(books[k]))
        for k in range(len(books)):
            used = np.flatnonzero(count[k])
            cols = [pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(count[k][used]), *map(pa.array, total[k][used].T)]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

    schema = "part int, entry int, n long" + "".join(f", s{i} long" for i in range(width))
    found = vecs.mapInArrow(sums, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    out = [b.copy() for b in books]
    for r in found.collect():  # at most one row for each entry of each codebook
        out[r.part][r.entry] = [s // r.n for s in r[3:]]
    return out


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def learn_books(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> list[np.ndarray]:
    """Codebooks by part from rows of id and v, vectors of one length: they start as the vectors of the smallest ids (nulls last)."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries)
    start = integer_parts(pa.array([r.v for r in first.collect()], pa.list_(pa.float64())), scale)
    books = np.split(start, parts, axis=1)
    vecs = rows.select("v")
    for _ in range(rounds):
        books = learnt_round(vecs, books, scale)
    return books


def with_codes(vecs: DataFrame, books: list[np.ndarray], scale: float = 1024.0) -> DataFrame:
    """Rows of any columns and v, vectors of the codebooks' length, with code (two hex digits by part) and error in v's place."""
    keep = [c for c in vecs.columns if c != "v"]
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for b in batches:
            found = _assigned(books, scale, b["v"])
            code = hexes[np.stack([at for _, at, _ in found], axis=1)].tolist() if b.num_rows else []
            err = np.sum([e for _, _, e in found], axis=0, dtype=np.int64) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(["".join(c) for c in code], pa.string()), pa.array(err, pa.int64())], names=[*keep, "code", "error"])

    schema = vecs.drop("v").schema.add("code", "string").add("error", "long")
    return vecs.mapInArrow(run, schema)


def usual_length(vectors: DataFrame, vec: Column, parts: int) -> int | None:
    """The length that most usable vectors have of those that parts divides (ties: the shorter); None without any."""
    sizes = vectors.where(usable(vec) & (F.size(vec) > 0) & (F.size(vec) % parts == 0)).groupBy(F.size(vec).alias("d")).agg(F.count("*").alias("n"))
    found = sizes.agg(F.min(F.struct((-F.col("n")).alias("m"), "d")).alias("x")).first().x
    return found and found.d


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector without null or non-finite components.

    Components count as floor(scale * x). Vectors of another length than most, or one that parts doesn't divide, take
    no part: their code and error are null. Rows of fewer vectors than entries start smaller codebooks; rows that repeat
    an id count each, in the order of their vectors, and null ids come last. label_error sums the errors of equal labels, nulls
    together. A component beyond 2^27 after scaling is an error. No vectors: no rows. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256, as a code has two hex digits by part")
    vec, label = F.col(vec_col), F.col(label_col)
    rows = vectors.where(usable(vec)).select(whole_id(vectors, id_col).alias("id"), vec.cast("array<double>").alias("v"), label.isNull().alias("l0"), F.coalesce(label.cast("string"), F.lit("")).alias("l1"))
    length = usual_length(vectors, vec, parts)
    fit = rows.where(F.size("v") == length) if length else rows.where("false")
    odd = rows.where(F.size("v") != length) if length else rows
    books = learn_books(fit.select("id", "v"), parts, entries, rounds, scale) if length else []
    coded = with_codes(fit, books, scale) if length else fit.select("id", "l0", "l1", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    done = written(coded.unionByName(odd.select("id", "l0", "l1", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))))
    totals = done.groupBy("l0", "l1").agg(F.count("*").alias("many"), F.sum("error").alias("label_error"))
    out = join_split(done, totals, ["l0", "l1"], "many", done.count())
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, width: int = 16) -> str:
    """DuckDB's SQL for vectors of parts * width components."""
    sql = f"""
    WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    p AS MATERIALIZED (SELECT vec_id, part, e[part * {width} + 1 : part * {width} + {width}] AS e FROM v, range({parts}) t(part)),
    first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}),
    b0 AS MATERIALIZED (SELECT part, entry, e FROM p JOIN first USING (vec_id)),"""
    for k in range(rounds + 1):
        sql += f"""
    a{k} AS MATERIALIZED (SELECT vec_id, part, min((d, entry)) AS m FROM (
      SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{k} b USING (part)) GROUP BY ALL),"""
        if k < rounds:
            sql += f"""
    m{k} AS (SELECT part, entry, list(x ORDER BY pos) AS e FROM (SELECT part, entry, pos, floor(sum(x) / count(*)) AS x FROM (
      SELECT p.part, struct_extract(a.m, 2) AS entry, unnest(p.e) AS x, unnest(range({width})) AS pos FROM p JOIN a{k} a USING (vec_id, part)) GROUP BY ALL) GROUP BY ALL),
    b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM b{k} b LEFT JOIN m{k} m USING (part, entry)),"""
    return sql + f"""
    sha AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) AS s FROM b{rounds}),
    c AS (SELECT vec_id, string_agg(printf('%02x', struct_extract(m, 2)), '' ORDER BY part) AS code, sum(struct_extract(m, 1))::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM c JOIN v USING (vec_id), sha"""
