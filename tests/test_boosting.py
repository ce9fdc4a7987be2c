"""Boosted trees, their importance and their curves against slow versions."""

import math

import numpy as np
import pytest

from strataline.operators import boosting as bo

NAMES = ["a", "b", "c"]


def sample(n=400, seed=1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)), 2)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + r.normal(scale=0.5, size=n) > 0.4).astype(int)
    gone = r.random((n, 3)) < 0.08
    return x, gone, y, r.integers(0, 6, n), r.integers(0, 3, n)


def frame(spark, n=400):
    x, gone, y, j, i = sample(n)
    rows = [(k, *[None if gone[k, f] else float(x[k, f]) for f in range(3)], int(y[k]), int(j[k]), int(i[k])) for k in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y int, j int, i int").repartition(4)


def area(score, y):
    hit, miss = score[y == 1], score[y == 0]
    return np.mean([(a > miss).mean() + (a == miss).mean() / 2 for a in hit])


def slow_fit(x, y, edges, features, trees, rate=0.05, depth=3, least=10, l2=1.0):
    """Row by row and split by split, with the same fixed point."""
    start = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    margin = np.full(len(y), start)
    total = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-(start + total)))
        g, h = np.rint((p - y) * bo.UNIT) / bo.UNIT, np.rint(p * (1 - p) * bo.UNIT) / bo.UNIT
        leaf = np.zeros(len(y))

        def grow(rows, d):
            if d == depth:
                leaf[rows] = -rate * g[rows].sum() / (h[rows].sum() + l2)
                return
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
            best = (1e-9, None)
            for f in features:
                for c in range(len(edges[f])):
                    for missing_left in (True, False):
                        left = np.where(x[rows, f] == bo.MISSING, missing_left, x[rows, f] <= c)
                        l, r = rows[left], rows[~left]
                        if len(l) >= least and len(r) >= least and score(l) + score(r) - score(rows) > best[0] + (1e-9 if best[1] is not None else 0):
                            best = (score(l) + score(r) - score(rows), (l, r))
            if best[1] is None:
                leaf[rows] = -rate * g[rows].sum() / (h[rows].sum() + l2)
            else:
                for part in best[1]:
                    grow(part, d + 1)

        grow(np.arange(len(y)), 0)
        total += leaf
    return start + total


@pytest.fixture(scope="module")
def ready(spark):
    df = frame(spark)
    edges = bo.bin_edges(df, NAMES, 12)
    rows = bo.binned(bo.block_folds(df, ["j", "i"], 2, 3), NAMES, "y", edges, ["id", "folds"])
    got = sorted(rows.collect())
    x = np.array([list(r.x) for r in got], np.uint8)
    return rows, edges, x, np.array([r.y for r in got]), np.array([r.folds for r in got])


def test_bins_and_folds(spark, ready):
    rows, edges, x, y, folds = ready
    raw, gone, want, j, i = sample()
    assert (y == want).all()
    for f in range(3):
        assert ((x[:, f] == bo.MISSING) == gone[:, f]).all()
        assert (x[~gone[:, f], f] == np.searchsorted(edges[f], raw[~gone[:, f], f], "left")).all()
    block = j * 3 + i
    for r in range(2):
        of = {b: set(folds[block == b, r]) for b in set(block)}
        assert all(len(s) == 1 for s in of.values())
        sizes = np.bincount([next(iter(s)) for s in of.values()], minlength=3)
        assert sizes.max() - sizes.min() <= 1
    assert (folds[:, 0] != folds[:, 1]).any()


def test_trees_as_a_slow_version_grows_them(spark, ready):
    rows, edges, x, y, folds = ready
    models = [bo.Model((0, 1, 2)), bo.Model((1, 2), (1, 0)), bo.Model((0,), (0, 2))]
    bo.fit(rows, models, edges, trees=7, rate=0.3, settle=3)
    for m in models:
        use = bo.training(m, folds)
        assert m.start + bo.margins(m, x[use]) == pytest.approx(slow_fit(x[use], y[use], edges, m.features, 7, 0.3), abs=1e-9)
    again = bo.fit(rows.repartition(7), [bo.Model((0, 1, 2))], edges, trees=7, rate=0.3, settle=7)[0]
    assert all((a.feature == b.feature).all() and (a.value == b.value).all() for a, b in zip(again.trees, models[0].trees))


def test_cross_validation(spark, ready):
    df = frame(spark)
    groups = {"all": NAMES, "noise": ["c"]}
    got = {r.group: (r.auc, r.sd) for r in bo.cross_validated(df, groups, "y", ["j", "i"], 2, 3, 12, trees=6, rate=0.3).collect()}
    _, edges, x, y, folds = ready
    for g, features in (("all", (0, 1, 2)), ("noise", (2,))):
        areas = []
        for r in range(2):
            score = np.zeros(len(y))
            for f in range(3):
                m = bo.fit(ready[0], [bo.Model(features, (r, f))], edges, trees=6, rate=0.3)[0]
                out = folds[:, r] == f
                score[out] = m.start + bo.margins(m, x[out])
            areas.append(area(score, y))
        assert got[g] == pytest.approx((np.mean(areas), np.std(areas)))
    assert got["all"][0] > 0.8 > got["noise"][0]


def test_importance_and_curves(spark, ready):
    rows, edges, x, y, _ = ready
    m = bo.fit(rows, [bo.Model((0, 1, 2))], edges, trees=8, rate=0.3)[0]
    for n in (1, 2, 5, 64, 400):
        to = bo.shuffled(np.arange(n), n, 3)
        assert sorted(to) == list(range(n))
    assert (bo.shuffled(np.arange(400), 400, 1) != bo.shuffled(np.arange(400), 400, 2)).mean() > 0.9
    placed, n = bo.numbered(rows.select("y", "x"))
    order = sorted(placed.collect(), key=lambda r: r.at)
    assert n == 400 and [r.at for r in order] == list(range(400))
    px, py = np.array([list(r.x) for r in order], np.uint8), np.array([r.y for r in order])
    got = {r.feature: (r["drop"], r.sd) for r in bo.permutation_importance(rows, m, NAMES, 4).collect()}
    whole = area(bo.margins(m, px), py)
    for f, name in enumerate(NAMES):
        drops = []
        for r in range(4):
            changed = px.copy()
            changed[:, f] = px[bo.shuffled(np.arange(400), 400, r), f]
            drops.append(whole - area(bo.margins(m, changed), py))
        assert got[name] == pytest.approx((np.mean(drops), np.std(drops)), abs=1e-9)
    curves = bo.partial_dependence(rows, m, NAMES, edges, ["a", "c"], 30, {"c": (-2.0, 2.0)}).collect()
    assert len(curves) == 60
    for r in curves:
        f = NAMES.index(r.feature)
        changed = x.copy()
        changed[:, f] = np.searchsorted(edges[f], r["at"], "left")
        assert r.margin == pytest.approx(m.start + bo.margins(m, changed).mean(), abs=1e-9)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1.0, None, 1, 0), (None, None, 0, 0), (2.0, None, None, 1)], "a double, b double, y int, j int")
    edges = bo.bin_edges(df, ["a", "b"], 4)
    rows = bo.binned(df, ["a", "b"], "y", edges, [])
    m = bo.fit(rows, [bo.Model((0, 1))], edges, trees=2, least=1)[0]
    assert rows.count() == 2 and len(m.trees) == 2 and m.start == 0.0
    none = bo.binned(df.where("false"), ["a", "b"], "y", edges, [])
    assert (bo.margins(bo.fit(none, [bo.Model((0, 1))], edges, trees=1)[0], np.zeros((1, 2), np.uint8)) == 0).all()
    assert bo.cross_validated(df.where("y is not null"), {"g": ["a"]}, "y", ["j"], 1, 2, 4, trees=1).first().auc is not None


def test_rows_carry_no_margins_until_settled_and_right_children_are_not_summed(spark, ready, monkeypatch):
    """Twenty models of depth 2: what the tasks take in and what they give for the second level."""
    rows, edges, *_ = ready
    models, seen = [bo.Model((0, 1), (r % 2, r % 3)) for r in range(20)], []
    cls = type(rows)
    plain = cls.mapInArrow
    monkeypatch.setattr(cls, "mapInArrow", lambda self, f, schema, *a, **k: (seen.append((set(self.columns), plain(self, f, schema, *a, **k))), seen[-1][1])[1])
    bo.fit(rows, models, edges, trees=1, rate=0.3, depth=2)
    assert all("m" not in took for took, _ in seen)
    assert {r.node for r in seen[-1][1].select("node").distinct().collect()} == {0}


def test_arrays_from_sliced_columns():
    import pyarrow as pa

    col = pa.array([bytes([k, k + 1]) for k in range(9)], pa.binary())
    assert bo.matrix(col.slice(3, 4), 2).tolist() == [[k, k + 1] for k in range(3, 7)]
    assert bo.folds_of(pa.array([[k, 2 * k] for k in range(9)], pa.list_(pa.int32())).slice(2, 3)).tolist() == [[2, 4], [3, 6], [4, 8]]
    assert bo.matrix(col.slice(0, 0), 2).shape == (0, 2)


def test_places_need_no_python_worker(spark, ready):
    placed, n = bo.numbered(ready[0].select("y", "x"))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert n == 400 and "LocalTableScan" in plan and plan.count("ExistingRDD") == 1
    assert bo.numbered(ready[0].where("false").select("y", "x"))[0].count() == 0
