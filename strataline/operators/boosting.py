"""Gradient-boosted trees of a yes or no, and what they rest on: cross-validation by block, permutation importance and
partial dependence.

Features are cut into bins once. A level of a tree is one pass: tasks sum gradients by node, feature and bin, Spark adds
them up, and the driver, which sees only those sums, picks the splits. Many models (subsets of features, folds that are
left out) grow in the same passes. Gradients are rounded to fixed point and added as whole numbers, so that no order of
adding, partitioning or lost executor changes a tree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranks, stats
from .steps import settled

#: The bin of a missing value, and the fixed point of gradients.
MISSING, UNIT = 255, float(1 << 20)


@dataclass
class Tree:
    """A whole binary tree: split k has the children 2k + 1 and 2k + 2; a split of feature -1 sends all rows left."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @property
    def depth(self) -> int:
        return (len(self.feature) + 1).bit_length() - 1


@dataclass
class Model:
    """Trees over some of the features, of the rows that aren't in a fold (column of folds, number); all rows if that is None."""

    features: tuple[int, ...]
    left_out: tuple[int, int] | None = None
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)


def goes_left(tree: Tree, x: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    """Whether rows of bins go left at split k (one for each row, or one for all)."""
    f = tree.feature[k]
    b = x[np.arange(len(x)), np.maximum(f, 0)]
    return np.where(f < 0, True, np.where(b == MISSING, tree.missing_left[k], b <= tree.cut[k]))


def goes_right(tree: Tree, x: np.ndarray, k: int) -> np.ndarray | np.uint8:
    """1 for each row of bins that goes right at split k, else 0: a table of all bins, looked up by bytes."""
    if tree.feature[k] < 0:
        return np.uint8(0)
    table = (np.arange(256) > tree.cut[k]).astype(np.uint8)
    table[MISSING] = not tree.missing_left[k]
    return np.frombuffer(x[:, tree.feature[k]].tobytes().translate(table.tobytes()), np.uint8)


def reached(tree: Tree, x: np.ndarray, levels: int) -> np.ndarray:
    """The node, counted from the left, that each row has reached after so many levels."""
    node = np.zeros(len(x), np.uint8 if levels < 8 else np.int64)
    for d in range(levels):
        right = np.zeros_like(node)
        for k in range(1 << d):
            right |= (node == k) & goes_right(tree, x, (1 << d) - 1 + k)
        node = 2 * node + right
    return node.astype(np.int64)


def margins(model: Model, x: np.ndarray, since: int = 0) -> np.ndarray:
    """Sum of the trees from one on, without the start."""
    out = np.zeros(len(x))
    x = np.asfortranarray(x)
    for tree in model.trees[since:]:
        out += tree.value[reached(tree, x, tree.depth)]
    return out


def bin_edges(df: DataFrame, features: list[str], bins: int = 64) -> list[np.ndarray]:
    """Upper ends of each feature's bins but the last: quantiles of its values, each once."""
    if not 2 <= bins < MISSING:
        raise ValueError("bins must be from 2 to 254")
    share = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = df.agg(*[F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), share, 20 * bins).alias(f"q{k}") for k, f in enumerate(features)]).first()
    return [np.unique(np.array(q if q is not None else [], float)) for q in found]


def binned(df: DataFrame, features: list[str], label: str, edges: list[np.ndarray], keep: list[str]) -> DataFrame:
    """keep, y (0 or 1) and x, a byte of bin by feature; settled, in as many parts as Spark has shuffle partitions.

    Missing and NaN values have a bin of their own; rows without a label are left out.
    """
    fields = [df.schema[c] for c in keep]

    def run(batches):
        for b in batches:
            x = np.full((b.num_rows, len(edges)), MISSING, np.uint8)
            for k, e in enumerate(edges):
                v = b[f"f{k}"].to_numpy(zero_copy_only=False)
                there = ~np.isnan(v)
                x[there, k] = np.searchsorted(e, v[there], "left")
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), b["y"], pa.array([r.tobytes() for r in x], pa.binary())], names=[*keep, "y", "x"])

    rows = df.where(F.col(label).isNotNull()).select(*keep, F.col(label).cast("int").alias("y"), *[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(rows.repartition(parts).mapInArrow(run, T.StructType([*fields, T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())])))


def matrix(col, width: int, kind=np.uint8) -> np.ndarray:
    """Rows of equally many bytes as an array, without a Python object for each."""
    size = width * np.dtype(kind).itemsize
    col = pa.concat_arrays([col]) if not isinstance(col, pa.ChunkedArray) else col.combine_chunks()
    if not len(col) or not size:
        return np.zeros((len(col), width), kind)
    fixed = col.cast(pa.binary(size))
    return np.frombuffer(fixed.buffers()[1], kind, len(fixed) * width, fixed.offset * size).reshape(len(fixed), width)


def folds_of(col) -> np.ndarray:
    return col.flatten().to_numpy().astype(np.int32).reshape(len(col), -1) if len(col) else np.zeros((0, 0), np.int32)


def training(model: Model, folds: np.ndarray) -> np.ndarray | slice:
    return slice(None) if model.left_out is None else folds[:, model.left_out[0]] != model.left_out[1]


def level_sums(x: np.ndarray, y: np.ndarray, margin: np.ndarray, node: np.ndarray, features: tuple[int, ...], nodes: int) -> np.ndarray:
    """rows, gradients and curvatures (fixed point) by feature, node and bin."""
    p = 1 / (1 + np.exp(-margin))
    g, h = np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT)
    out, at = np.empty((3, len(features), nodes, 256)), node * 256
    for k, f in enumerate(features):
        key = at + x[:, f]
        for s, w in enumerate((None, g, h)):
            out[s, k] = np.bincount(key, w, nodes * 256).reshape(nodes, 256)
    return out.astype(np.int64)


def best_splits(sums: np.ndarray, features: tuple[int, ...], edges: list[np.ndarray], least: int, l2: float):
    """For each node (feature, cut, missing left, [left, right] gradients and curvatures); feature -1 where no split gains.

    Equal gains go to the first feature, the lowest cut and missing values on the left.
    """
    cuts = max((len(edges[f]) for f in features), default=0)
    n, g, h = sums[0].astype(float), sums[1] / UNIT, sums[2] / UNIT
    whole = [s[0].sum(axis=1)[:, None, None, None] for s in (n, g, h)]
    # by node, feature, cut, and whether missing values go left
    left = [s[:, :, :cuts].cumsum(axis=2).transpose(1, 0, 2)[..., None] + s[:, :, MISSING].T[:, :, None, None] * np.array([1, 0]) for s in (n, g, h)]
    right = [w - x for w, x in zip(whole, left)]
    score = lambda s: s[1] ** 2 / (s[2] + l2)
    gain = score(left) + score(right) - score(whole)
    there = np.arange(cuts) < np.array([len(edges[f]) for f in features])[:, None]
    gain[~(there[None, :, :, None] & (left[0] >= least) & (right[0] >= least))] = 0
    out = []
    for k in range(len(gain)):
        at = int(gain[k].argmax()) if gain[k].size else 0
        if gain[k].size and gain[k].flat[at] > 1e-9:
            f, c, m = np.unravel_index(at, gain[k].shape)
            out.append((features[f], int(c), m == 0, *[(float(x[k, f, c, m]), float(y[k, f, c, m])) for x, y in zip(left[1:], right[1:])]))
        else:
            out.append((-1, 0, True, (float(whole[1][k, 0, 0, 0]), 0.0), (float(whole[2][k, 0, 0, 0]), 0.0)))
    return out


def fit(rows: DataFrame, models: list[Model], edges: list[np.ndarray], trees: int = 200, rate: float = 0.05, depth: int = 3, least: int = 10, l2: float = 1.0, settle: int = 10) -> list[Model]:
    """The models with their trees, from rows of y, x and folds (an array of ints), as binned gives.

    Every settle trees the rows are written with what the trees so far give them; before that they carry no margins.
    Below the top only left children are summed: a right child's sums are its parent's less its sibling's, in whole numbers.
    """
    width, wide = len(edges), max([m.left_out[0] for m in models if m.left_out], default=-1) + 1
    schema = "model int, feature int, node int, bin int, n long, g long, h long"

    def unpacked(b):
        before = matrix(b["m"], len(models), np.float64) if "m" in b.schema.names else np.zeros((1, len(models))).repeat(b.num_rows, 0)
        return np.asfortranarray(matrix(b["x"], width)), b["y"].to_numpy(), folds_of(b["folds"]) if wide else None, before

    kept = rows.select("y", "x", *(["folds"] if wide else []))
    names = kept.columns
    with_m = T.StructType([*kept.schema.fields, T.StructField("m", T.BinaryType())])
    rows = kept
    counts = kept.groupBy(*(["folds"] if wide else [])).agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()  # as many rows as there are combinations of folds
    for m in models:
        mine = [r for r in counts if m.left_out is None or r.folds[m.left_out[0]] != m.left_out[1]]
        n, y = sum(r.n for r in mine), sum(r.y or 0 for r in mine)
        m.start = math.log((y + 0.5) / (n - y + 0.5))
    since = 0
    for t in range(trees):
        for m in models:
            size = (1 << depth) - 1
            m.trees.append(Tree(np.full(size, -1), np.zeros(size, np.int64), np.ones(size, bool), np.zeros(size + 1)))
        above: dict[int, np.ndarray] = {}
        for d in range(depth):
            half = max(1, 1 << d >> 1)

            def sums(batches, d=d, since=since, half=half):
                total = [np.zeros((3, len(m.features), half, 256), np.int64) for m in models]
                for b in batches:
                    x, y, folds, before = unpacked(b)
                    for k, m in enumerate(models):
                        grown = Model(m.features, trees=m.trees[:-1])
                        margin, node = m.start + before[:, k] + margins(grown, x, since), reached(m.trees[-1], x, d)
                        use = np.ones(len(x), bool) if m.left_out is None else training(m, folds)
                        use = np.flatnonzero(use & (node % 2 == 0))
                        total[k] += level_sums(x[use], y[use], margin[use], node[use] >> 1 if d else node[use], m.features, half)
                for k, m in enumerate(models):
                    f, node, at = np.nonzero(total[k][0])
                    cols = [np.full(len(f), k), np.array(m.features)[f], node, at]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in cols), *(pa.array(total[k][s][f, node, at]) for s in range(3))], names=["model", "feature", "node", "bin", "n", "g", "h"])

            found = rows.mapInArrow(sums, schema).groupBy("model", "feature", "node", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))
            got = {c: v.to_numpy() for c, v in zip(found.columns, found.toArrow().combine_chunks().itercolumns())}  # bounded by the models' size
            for k, m in enumerate(models):
                mine = got["model"] == k
                whole = np.zeros((3, len(m.features), half, 256), np.int64)
                place = np.searchsorted(m.features, got["feature"][mine])
                for s, c in enumerate("ngh"):
                    whole[s, place, got["node"][mine], got["bin"][mine]] = got[c][mine]
                if d:
                    whole = np.stack([whole, above[k] - whole], axis=3).reshape(3, len(m.features), 1 << d, 256)
                above[k] = whole
                tree = m.trees[-1]
                for node, (f, cut, missing_left, g, h) in enumerate(best_splits(whole, m.features, edges, least, l2)):
                    at = (1 << d) - 1 + node
                    tree.feature[at], tree.cut[at], tree.missing_left[at] = f, cut, missing_left
                    if d == depth - 1:
                        tree.value[2 * node : 2 * node + 2] = [-rate * a / (b + l2) for a, b in zip(g, h)]
        if (t + 1) % settle == 0 and t + 1 < trees:

            def moved(batches, since=since):
                for b in batches:
                    x, _, _, before = unpacked(b)
                    now = before + np.stack([margins(m, x, since) for m in models], axis=1)
                    yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array([r.tobytes() for r in now], pa.binary())], names=[*names, "m"])

            rows, since = settled(rows.mapInArrow(moved, with_m)), t + 1
    return models


def block_folds(df: DataFrame, block: list[str], reps: int = 5, folds: int = 5) -> DataFrame:
    """df with folds, a number from 0 for each repetition: whole blocks, shuffled by a hash, as equal in number as can be."""
    blocks = df.select(*block).distinct()
    each = blocks.select(*block, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("_rep"))
    each = each.withColumn("_h", F.xxhash64("_rep", *block)).groupBy("_rep", "_h").agg(F.collect_list(F.struct(*block)).alias("_b")).withColumn("_n", F.size("_b").cast("long"))
    fold = F.floor(F.col("before__n") * folds / F.col("all__n")).cast("int")
    placed = ranks.running(each, ["_rep"], "_h", ["_n"]).select("_rep", F.explode("_b").alias("_b"), fold.alias("_f")).select("_b.*", F.struct("_rep", "_f").alias("_p"))
    of = placed.groupBy(*block).agg(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["_f"]).alias("folds"))
    return df.join(of, block)


def scored(rows: DataFrame, models: list[Model], keep: list[str], width: int) -> DataFrame:
    """keep, y, model, score: every row's margin under each model that it was left out of (under all that leave out none)."""
    fields = [rows.schema[c] for c in keep]
    wide = any(m.left_out for m in models)

    def run(batches):
        for b in batches:
            x = matrix(b["x"], width)
            folds = folds_of(b["folds"]) if wide else None
            for k, m in enumerate(models):
                use = np.arange(b.num_rows) if m.left_out is None else np.flatnonzero(folds[:, m.left_out[0]] == m.left_out[1])
                part = b.take(pa.array(use))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), part["y"], pa.array(np.full(len(use), k, np.int32)), pa.array(m.start + margins(m, x[use]))], names=[*keep, "y", "model", "score"])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("y", T.IntegerType()), T.StructField("model", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def cross_validated(df: DataFrame, groups: dict[str, list[str]], label: str, block: list[str], reps: int = 5, folds: int = 5, bins: int = 64, **how) -> DataFrame:
    """group, auc, sd: mean and (population) standard deviation over repetitions of the area under the curve of held-out blocks."""
    features = sorted({f for g in groups.values() for f in g})
    edges = bin_edges(df, features, bins)
    rows = binned(block_folds(df, block, reps, folds), features, label, edges, ["folds"])
    names = [g for g in groups for _ in range(reps * folds)]
    models = [Model(tuple(sorted(features.index(f) for f in groups[g])), (r, f)) for g in groups for r in range(reps) for f in range(folds)]
    fit(rows, models, edges, **how)
    rep = F.array(*[F.lit(m.left_out[0]) for m in models])
    name = F.array(*map(F.lit, names))
    out = scored(rows, models, [], len(features)).select("y", "score", F.element_at(name, F.col("model") + 1).alias("group"), F.element_at(rep, F.col("model") + 1).alias("rep"))
    return stats.auc(out, ["group", "rep"], "score", "y").groupBy("group").agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("sd"))


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Settled rows with at, their places from 0 without gaps, and how many there are. A number for each partition comes here."""
    marked = settled(rows.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = marked.groupBy(part.alias("p")).count().orderBy("p").collect()
    before, n = {}, 0
    for r in sizes:
        before[r.p], n = n, n + r["count"]
    # from Arrow: rows of Python objects would start another kind of Python worker beside that of mapInArrow in each executor
    ends = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"_p": pa.array(list(before) or [0], pa.int64()), "_before": pa.array(list(before.values()) or [0], pa.int64())})))
    return marked.withColumn("_p", part).join(ends, "_p").withColumn("at", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_p", "_id", "_before"), n


def shuffled(at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a seeded permutation of 0..n-1 sends places: four rounds of a Feistel network, walked until inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(1, 1 << 63, 4, dtype=np.uint64)
    out, todo = at.astype(np.uint64), np.arange(len(at))
    while len(todo):
        a, b = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            mix = (b ^ k) * np.uint64(0x9E3779B97F4A7C15)
            a, b = b, a ^ ((mix ^ (mix >> np.uint64(29))) >> np.uint64(17) & mask)
        out[todo] = a << np.uint64(half) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def permutation_importance(rows: DataFrame, model: Model, names: list[str], repeats: int = 30, width: int | None = None) -> DataFrame:
    """feature, drop, sd: by how much the area under the curve falls when a feature's values are dealt to other rows.

    In each repetition every row asks one other row, the same for all features, for its values; no column is gathered.
    Each row is scored once as it is and once for each feature.
    """
    width = width or len(names)
    placed, n = numbered(rows.select("y", "x"))
    schema = "rep int, feature int, y int, score double"

    def asking(batches):
        for b in batches:
            at = b["at"].to_numpy()
            for r in range(repeats):
                yield pa.RecordBatch.from_arrays([b["y"], b["x"], pa.array(np.full(len(at), r, np.int32)), pa.array(shuffled(at, n, r))], names=["y", "x", "rep", "at"])

    def scoring(batches):
        for b in batches:
            x, other = matrix(b["x"], width), matrix(b["other"], width)
            for f in model.features:
                changed = x.copy()
                changed[:, f] = other[:, f]
                yield pa.RecordBatch.from_arrays([b["rep"], pa.array(np.full(len(x), f, np.int32)), b["y"], pa.array(margins(model, changed))], names=["rep", "feature", "y", "score"])

    asked = placed.select("y", "x", "at").mapInArrow(asking, "y int, x binary, rep int, at long")
    met = asked.join(placed.select("at", F.col("x").alias("other")), "at").select("rep", "y", "x", "other").mapInArrow(scoring, schema)
    plain = stats.auc(scored(rows.select("y", "x"), [Model(model.features, None, 0.0, model.trees)], [], width), [], "score", "y").select(F.col("auc").alias("whole"))
    drops = stats.auc(met, ["rep", "feature"], "score", "y").join(F.broadcast(plain))  # one row
    out = drops.groupBy("feature").agg(F.avg(F.col("whole") - F.col("auc")).alias("drop"), F.stddev_pop(F.col("whole") - F.col("auc")).alias("sd"))
    return out.select(F.element_at(F.array(*map(F.lit, names)), F.col("feature") + 1).alias("feature"), "drop", "sd")


def partial_dependence(rows: DataFrame, model: Model, names: list[str], edges: list[np.ndarray], features: list[str], points: int = 30, ends: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """feature, at, margin: the mean margin of all rows if the feature had the value at, over a grid of values.

    Whether a row goes left at each split of a tree is counted once, as a pattern of bits: a tree of depth 3 has 128. The
    mean over all rows with a feature's splits set to a value's is then a sum over patterns, for any feature and grid.
    """
    width, size = len(names), len(model.trees[0].feature) if model.trees else 0

    def patterns(batches):
        total = np.zeros((len(model.trees), 1 << size), np.int64)
        for b in batches:
            x = matrix(b["x"], width)
            for t, tree in enumerate(model.trees):
                bits = sum(goes_left(tree, x, np.full(len(x), k)).astype(np.int64) << k for k in range(size))
                total[t] += np.bincount(bits, minlength=1 << size)
        t, p = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(p, pa.int32()), pa.array(total[t, p])], names=["tree", "pattern", "n"])

    found = rows.select("x").mapInArrow(patterns, "tree int, pattern int, n long").groupBy("tree", "pattern").agg(F.sum("n").alias("n")).collect()
    n = sum(r.n for r in found) // max(1, len(model.trees))
    out = []
    for name in features:
        f = names.index(name)
        e = edges[f]
        a, z = (ends or {}).get(name) or ((float(e[0]), float(e[-1])) if len(e) else (0.0, 0.0))
        for v in np.linspace(a, z, points):
            b = int(np.searchsorted(e, v, "left"))
            total = 0.0
            for r in found:
                tree, node = model.trees[r.tree], 0
                for d in range(tree.depth):
                    k = node + (1 << d) - 1
                    left = b <= tree.cut[k] if tree.feature[k] == f else r.pattern >> k & 1
                    node = 2 * node + (not left)
                total += r.n * tree.value[node]
            out.append((name, float(v), float(model.start + total / n) if n else None))
    return rows.sparkSession.createDataFrame(out, "feature string, at double, margin double")
