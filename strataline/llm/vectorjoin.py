"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are turned to their principal axes and sorted by the grid cells (of the join's width) of the leading
ones. The sequence is cut into intervals of bounded size; pairs of intervals whose bounding boxes lie within the
width are joined, one pair to a task, by halving both sides again and again and dropping every pair of pieces whose
boxes are provably too far apart. What is left is compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_split, whole_id
from .components import Forest, components
from .topk import matrix, usable

LEAF = 256
#: Boxes that the driver compares itself; more intervals are first bundled into so many runs of the sequence.
RUNS = 512


def _unit(col: pa.ChunkedArray) -> np.ndarray:
    m = matrix(col)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.sqrt(np.square(m).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """The axes, largest spread first, of all unit vectors: per-task sums of products, summed by Spark (dim x dim numbers)."""

    def partial(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                u = _unit(pa.chunked_array([b["v"]]))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["i", "x"])

    sums = vectors.select("v").mapInArrow(partial, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    m = np.zeros(dim * dim)
    m[[r.i for r in sums]] = [r.x for r in sums]
    m = m.reshape(dim, dim)
    _, axes = np.linalg.eigh((m + m.T) / 2)
    return axes[:, ::-1]


def sequence_join(a: np.ndarray, b: np.ndarray | None, ya: np.ndarray, yb: np.ndarray | None, least: float, width: float, found) -> None:
    """found(i, j) for index arrays of linked rows of a and b (of a alone where b is None, each pair once)."""
    alone = b is None
    if alone:
        b, yb = a, ya
    limit = width * width + 1e-9

    def near(i0, i1, j0, j1):
        x, y = ya[i0:i1], yb[j0:j1]
        gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        return gap @ gap <= limit

    stack = [(0, len(a), 0, len(b))]
    while stack:
        i0, i1, j0, j1 = stack.pop()
        same = alone and (i0, i1) == (j0, j1)
        if i1 == i0 or j1 == j0 or not (same or near(i0, i1, j0, j1)):
            continue
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            cos = a[i0:i1] @ b[j0:j1].T
            i, j = np.nonzero(cos >= least)
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                found(i + i0, j + j0)
            continue
        im, jm = (i0 + i1) // 2, (j0 + j1) // 2
        if same:
            stack += [(i0, im, j0, jm), (i0, im, jm, j1), (im, i1, jm, j1)]
        elif i1 - i0 >= j1 - j0:
            stack += [(i0, im, j0, j1), (im, i1, j0, j1)]
        else:
            stack += [(i0, i1, j0, jm), (i0, i1, jm, j1)]


def _linked(distinct: DataFrame, dim: int, least: float, interval: int, lead: int) -> DataFrame:
    """rid, links, root: parts of the links of distinct vectors, from each pair of intervals."""
    width = math.sqrt(max(0.0, 2 - 2 * least))
    axes = principal_axes(distinct, dim)
    leading = axes[:, : min(lead, dim)]

    def cells(batches):
        for b in batches:
            if b.num_rows:
                grid = np.floor(_unit(pa.chunked_array([b["v"]])) @ leading / max(width, 1e-6)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b["rid"], b["w"], b["v"], pa.array(list(grid), pa.list_(pa.int32()))], names=["rid", "w", "v", "cell"])

    v_type = distinct.schema["v"].dataType.simpleString()
    laid = distinct.select("rid", "w", "v").mapInArrow(cells, f"rid long, w long, v {v_type}, cell array<int>")
    laid = cut(laid.repartitionByRange("cell", "rid").sortWithinPartitions("cell", "rid").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = laid.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    laid = cut(laid.withColumn("part", part).join(before, "part").select("rid", "w", "v", rank.alias("rank"), (rank / interval).cast("long").alias("iv")))

    def box(group: pa.Table) -> pa.Table:
        y = _unit(group["v"]) @ axes
        return pa.table({"iv": group["iv"][:1], "lo": pa.array([y.min(0)], pa.list_(pa.float64())), "hi": pa.array([y.max(0)], pa.list_(pa.float64()))})

    boxes = cut(laid.select("iv", "v").groupBy("iv").applyInArrow(box, "iv long, lo array<double>, hi array<double>"))
    run = max(1, math.ceil((boxes.agg(F.max("iv")).first()[0] + 1) / RUNS))
    boxes = boxes.withColumn("run", (F.col("iv") / run).cast("long"))
    side = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(dim)]).alias(c)
    tops = [(r.run, np.array(r.lo), np.array(r.hi)) for r in boxes.groupBy("run").agg(side(F.min, "lo"), side(F.max, "hi")).collect()]
    close = [(p, q) for p, pl, ph in tops for q, ql, qh in tops if p <= q and np.square(np.maximum(0, np.maximum(pl - qh, ql - ph))).sum() <= width * width + 1e-9]
    pairs = distinct.sparkSession.createDataFrame(close, "p long, q long")
    name = lambda s: boxes.select(F.col("run").alias("p" if s == "x" else "q"), F.col("iv").alias(s), F.col("lo").alias(f"{s}l"), F.col("hi").alias(f"{s}h"))
    gap = lambda lo, hi: F.zip_with(lo, hi, lambda u, v: F.greatest(u - v, F.lit(0.0)))
    far = F.aggregate(F.zip_with(gap("xl", "yh"), gap("yl", "xh"), lambda u, v: u * u + v * v), F.lit(0.0), lambda s, g: s + g)
    pairs = pairs.join(name("x"), "p").join(name("y"), "q").where((F.col("x") <= F.col("y")) & (far <= width * width + 1e-9)).select("x", "y")
    first = laid.join(pairs, laid.iv == pairs.x).select("x", "y", F.lit(0).alias("s"), "rid", "w", "v", "rank")
    second = laid.join(pairs.where("x <> y"), laid.iv == F.col("y")).select("x", "y", F.lit(1).alias("s"), "rid", "w", "v", "rank")

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by([("s", "ascending"), ("rank", "ascending")])
        u, w, rid = _unit(group["v"]), group["w"].to_numpy(), group["rid"].to_numpy()
        y, cut_at = u @ axes, int((group["s"].to_numpy() == 0).sum())
        # smaller ids first, so that roots are smallest ids
        by_id = np.argsort(rid)
        place = np.empty(len(rid), np.int64)
        place[by_id] = np.arange(len(rid))
        links, forest = np.zeros(len(rid), np.int64), Forest(len(rid))
        shift = 0 if cut_at == len(rid) else cut_at

        def found(i, j):
            j = j + shift
            links[:] += np.bincount(i, w[j], len(links)).astype(np.int64) + np.bincount(j, w[i], len(links)).astype(np.int64)
            forest.link(place[i], place[j])

        if shift:
            sequence_join(u[:shift], u[shift:], y[:shift], y[shift:], least, width, found)
        else:
            sequence_join(u, None, y, None, least, width, found)
        root = rid[by_id][forest.root[place]]
        some = links > 0
        return pa.table({"rid": rid[some], "links": links[some], "root": root[some]})

    return first.unionAll(second).groupBy("x", "y").applyInArrow(meet, "rid long, links long, root long")


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", interval: int = 8192, lead: int = 4) -> DataFrame:
    """One row per row of vectors: its id, n_links, component_id, kept; linked are rows of cosine >= least (in doubles).

    Equal vectors are compared once and counted as often as they stand. Vectors that are null, empty, all zero or hold
    null or non-finite components link with nothing, nor do vectors of different length; they are their own component,
    a null id too (kept: true).
    Repeated rows link with each other like any equal vectors. No rows: no rows. Other columns are ignored.
    """
    rows = vectors.select(whole_id(vectors, id_col).alias("id"), F.col(vec_col).alias("v"))
    fit = usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    distinct = cut(rows.where(fit).groupBy("v").agg(F.min("id").alias("rid"), F.count("*").alias("w")))
    found = None
    for (dim,) in distinct.select(F.size("v")).distinct().collect():  # in practice one length
        part = _linked(distinct.where(F.size("v") == dim), dim, least, interval, lead)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "rid long, links long, root long")
    found = cut(found)
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    known = distinct.join(links, "rid", "left").join(roots, F.col("rid") == F.col("node"), "left")
    known = known.select("v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("component", "rid").alias("component"), "w")
    total = distinct.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    # rows without a usable vector skip the join on it
    good = join_split(rows.where(fit), known, ["v"], "w", total).select("id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.where(~F.coalesce(fit, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionAll(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
