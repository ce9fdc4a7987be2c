"""Exact top-k inner products by columnar branch-and-bound.

Queries and candidates are dealt into blocks of bounded size; one task takes one block of each. Inside, the
candidates stand column by column in blocks of dimensions. For each query the scores are summed block by block, and
after each block a candidate stays only while its partial score plus the most that the remaining dimensions can add
(the product of the remaining norms, by Cauchy and Schwarz) reaches the k-th best score known so far; survivors are
compacted. The k best of each pair of blocks meet in one ranking by query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import whole_id

DIMS_PER_BLOCK = 8
#: Below this every sum of products of integers is exact in doubles.
EXACT = float(1 << 53)


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null, and every component a finite number."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False))


def matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    col = col.combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def own_rows(queries: np.ndarray, q_ids: np.ndarray, cands: np.ndarray, c_ids: np.ndarray) -> np.ndarray:
    """For each query the place of one candidate of its id and vector, its own row or one just like it; -1 if it isn't here."""
    order = np.argsort(c_ids, kind="stable")
    lo, hi = (np.searchsorted(c_ids[order], q_ids, side) for side in ("left", "right"))
    return np.array([next((j for j in order[a:b] if (cands[j] == q).all()), -1) for q, a, b in zip(queries, lo, hi)], np.int64)


def best_of_block(queries: np.ndarray, q_ids: np.ndarray, cands: np.ndarray, c_ids: np.ndarray, k: int) -> list[tuple]:
    """(query row, candidate rows, scores) of the k best of each query; ties go to smaller candidate ids."""
    own = own_rows(queries, q_ids, cands, c_ids)
    dims = np.argsort(-np.square(cands).sum(axis=0), kind="stable")
    cands, queries = cands[:, dims], queries[:, dims]
    edges = list(range(0, cands.shape[1], DIMS_PER_BLOCK)) + [cands.shape[1]]
    vertical = [np.ascontiguousarray(cands[:, a:b]) for a, b in zip(edges, edges[1:])]

    def rest(x: np.ndarray) -> list[np.ndarray]:
        tail = np.cumsum(np.square(x)[:, ::-1], axis=1)[:, ::-1]
        return [np.sqrt(tail[:, e]) if e < x.shape[1] else np.zeros(len(x)) for e in edges[1:]]

    c_rest, q_rest = rest(cands), rest(queries)
    out = []
    for i, q in enumerate(queries):
        alive = np.flatnonzero(np.arange(len(c_ids)) != own[i])
        partial = (vertical[0] @ q[: edges[1]])[alive] if vertical else np.zeros(len(alive))
        floor = -np.inf
        for b in range(1, len(vertical)):
            if len(alive) <= k:
                partial = partial + vertical[b][alive] @ q[edges[b] : edges[b + 1]]
                continue
            if b == 1:  # the whole scores of a few promising candidates
                tried = alive[np.argpartition(-partial, k - 1)[:k]]
                floor = (cands[tried] @ q).min()
            reach = c_rest[b - 1][alive] * q_rest[b - 1][i]
            low = partial - reach
            floor = max(floor, low[np.argpartition(-low, k - 1)[k - 1]])
            # the bound's own rounding is far below this slack
            keep = partial + reach * (1 + 1e-9) + 1e-6 >= floor
            if not keep.all():
                alive, partial = alive[keep], partial[keep]
            partial = partial + vertical[b][alive] @ q[edges[b] : edges[b + 1]]
        top = np.lexsort((c_ids[alive], -partial))[:k]
        out.append((i, alive[top], partial[top]))
    return out


def _exactly(queries: np.ndarray, q_ids: np.ndarray, cands: np.ndarray, c_ids: np.ndarray, k: int) -> list[tuple]:
    """The same in unbounded integers, for components too large for doubles."""
    whole = lambda m: [[int(x) for x in row] for row in m]
    big = whole(cands)
    own = own_rows(queries, q_ids, cands, c_ids)
    out = []
    for i, q in enumerate(whole(queries)):
        scored = sorted((-sum(a * b for a, b in zip(q, c)), c_ids[j], j) for j, c in enumerate(big) if j != own[i])[:k]
        out.append((i, [j for _, _, j in scored], [-s for s, _, _ in scored]))
    return out


def _in_64_bits(score: int) -> int:
    if not -(1 << 63) <= score < 1 << 63:
        raise OverflowError(f"the score {score} needs more than 64 bits: use a smaller scale")
    return score


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = 2048, cand_block: int = 8192) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k rows of highest integer inner product with each query row.

    Components count as floor(scale * x). A query's own row isn't its candidate, though others of its id are; equal scores
    go to the smaller id. Query rows of one id are asked one by one and have a ranking each.
    Vectors that are null or hold null or non-finite components take no part; vectors of another length than the
    query's aren't its candidates. Repeated rows count as often as they stand. A score beyond 64 bits is an error.
    No vectors: no rows. Other columns are ignored.
    """
    rows = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(whole_id(vectors, id_col).alias("id"), F.col(vec_col).alias("v"), F.size(vec_col).alias("dim"), is_query.alias("q"))
    n, nq = rows.agg(F.count("*"), F.count_if("q")).first()
    q_blocks, c_blocks = max(1, math.ceil(nq / query_block)), max(1, math.ceil(n / cand_block))
    deal = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # rows of one id and vector are alike, so that their numbers may change hands without changing a result
    nth = F.row_number().over(Window.partitionBy("id").orderBy("v")).cast("long")
    cands = rows.select("dim", every(q_blocks).alias("qb"), deal(c_blocks).alias("cb"), F.lit(False).alias("q"), "id", F.lit(0).cast("long").alias("nth"), "v")
    asked = rows.where("q").withColumn("nth", nth).select("dim", deal(q_blocks).alias("qb"), every(c_blocks).alias("cb"), F.lit(True).alias("q"), "id", "nth", "v")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "nth", "vec_id", "score")])

    def meet(group: pa.Table) -> pa.Table:
        is_q = group["q"].to_numpy(zero_copy_only=False).astype(bool)
        ids, m = group["id"].to_numpy(), np.floor(matrix(group["v"]) * scale) if group["dim"][0].as_py() else np.zeros((len(is_q), 0))
        nths = group["nth"].to_numpy()[is_q]
        found: list[list] = [[], [], [], []]
        if is_q.any() and not is_q.all():
            size = np.abs(m).max(initial=0.0)
            way = best_of_block if size * size * max(1, m.shape[1]) < EXACT else _exactly
            q_ids, c_ids = ids[is_q], ids[~is_q]
            for i, rows_, scores in way(m[is_q], q_ids, m[~is_q], c_ids, k):
                for j, s in zip(rows_, scores):
                    for column, x in zip(found, (int(q_ids[i]), int(nths[i]), int(c_ids[j]), _in_64_bits(int(s)))):
                        column.append(x)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["query_id", "nth", "vec_id", "score"])

    met = cands.unionByName(asked).groupBy("dim", "qb", "cb").applyInArrow(meet, schema)
    order = Window.partitionBy("query_id", "nth").orderBy(F.desc("score"), F.asc("vec_id"))
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 50, k: int = 5) -> str:
    return f"""
    WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, q.rid AS qid, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON q.rid <> c.rid AND len(q.e) = len(c.e) WHERE q.vec_id % {every} = 0)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
