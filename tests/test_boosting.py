from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chargeframe.operators import boosting, ensemble
from chargeframe.operators.boosting import BINS, UNIT, Settings, sampled


def plain_fit(x, y, uid, val, s: Settings, cuts, base):
    """The same model row by row: one leaf is split at a time, every split is found on the leaf's own rows."""
    bins = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1)
    f, trees, losses = np.full(len(y), base), [], []

    def loss():
        e = (y - f)[val]
        return np.mean(e * e) if s.alpha is None else np.mean(np.maximum(s.alpha * e, (s.alpha - 1) * e))

    losses.append(loss())
    best, best_rounds = losses[0], 0
    for r in range(s.rounds):
        rng = np.random.default_rng([s.seed, r])
        columns = sorted(rng.choice(len(cuts), max(1, round(s.columns * len(cuts))), replace=False))
        seen = ~val & (sampled(uid, s.rows, s.seed, r) if s.rows < 1 else True)
        g = np.rint((f - y if s.alpha is None else np.where(y > f, -s.alpha, 1 - s.alpha)) * UNIT) / UNIT
        shrunk = lambda a: np.sign(a) * max(abs(a) - s.l1, 0)

        def worth(rows):
            return shrunk(g[rows].sum()) ** 2 / (len(rows) + s.l2)

        def split(rows, depth):
            found = None
            if s.depth is not None and depth >= s.depth:
                return None
            for c in columns:
                for b in range(BINS):
                    left = bins[rows, c] <= b
                    if min(left.sum(), (~left).sum()) >= max(1, s.min_rows):
                        gain = worth(rows[left]) + worth(rows[~left]) - worth(rows)
                        if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                            found = (gain, c, b)
            return found

        leaves = [((), np.flatnonzero(seen), np.arange(len(y)))]
        splits = {(): split(leaves[0][1], 0)}
        while len(leaves) < (s.leaves or 10 ** 9):
            ready = [x for x in leaves if splits[x[0]]]
            if not ready:
                break
            path, rows, every = leaf = min(ready, key=lambda x: (-round(splits[x[0]][0], 7), len(x[0]), x[0]))
            leaves = [x for x in leaves if x is not leaf]
            _, c, b = splits[path]
            for side in (0, 1):
                pick = lambda at: at[(bins[at, c] > b) == side]
                leaves.append(((*path, side), pick(rows), pick(every)))
                splits[(*path, side)] = split(leaves[-1][1], len(path) + 1)
        step = np.zeros(len(y))
        for _, rows, every in leaves:
            if s.alpha is None:
                step[every] = -shrunk(g[rows].sum()) / (len(rows) + s.l2)
            else:
                own = np.sort((y - f)[every[~val[every]]])
                step[every] = own[int(np.ceil(s.alpha * len(own))) - 1]
        f = f + s.rate * step
        trees.append(len(leaves))
        losses.append(loss())
        if losses[-1] < best:
            best, best_rounds = losses[-1], r + 1
        elif s.patience is not None and r + 1 - best_rounds >= s.patience:
            break
    return trees, losses, best, best_rounds


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 260
    x = np.round(rng.normal(size=(n, 4)), 1)
    y = np.round(2 * x[:, 0] - np.abs(x[:, 1]) + x[:, 2] * (x[:, 0] > 0) + rng.normal(size=n) / 2, 2)
    val = rng.random(n) < 0.3
    rows = [(*map(float, a), float(b), bool(c)) for a, b, c in zip(x, y, val)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, _val boolean").select(
        F.array("a", "b", "c", "d").alias("features"), "y", "_val")
    uid = np.array([r[0] for r in df.select(F.xxhash64("features", "y")).collect()], np.int64).view(np.uint64)
    return df, x, y, val, uid


CASES = [
    Settings(12, 0.3, leaves=7, min_rows=5, l1=0.5, l2=2.0),
    Settings(10, 0.2, depth=4, min_rows=3, rows=0.8, columns=0.6, seed=3),
    Settings(40, 0.9, leaves=12, depth=6, min_rows=2, patience=3),
    Settings(8, 0.3, leaves=6, min_rows=8, alpha=0.9),
    Settings(30, 0.8, depth=3, min_rows=4, alpha=0.5, patience=2, rows=0.9),
]


def test_models_in_step_equal_plain_ones(data):
    df, x, y, val, uid = data
    fitted = boosting.fit(df, CASES, "y")
    train = np.sort(y[~val])
    cuts = boosting.cut_points(df.filter("not _val"), "features", 4)
    for s, got in zip(CASES, fitted):
        base = y[~val].mean() if s.alpha is None else train[int(np.ceil(s.alpha * len(train))) - 1]
        sizes, losses, best, best_rounds = plain_fit(x, y, uid, val, s, cuts, base)
        assert got.fitted_rounds == len(sizes) and got.model.rounds == best_rounds
        own = [h[1, 2 if s.alpha is None else 3] / h[1, 0] for h in got.history]
        assert own == pytest.approx(losses, rel=1e-6) and got.best == pytest.approx(best, rel=1e-6)
        ends = np.append(got.model.roots[1:], len(got.model.feature))
        assert [int((got.model.feature[a:b] < 0).sum()) for a, b in zip(got.model.roots, ends)] == sizes[:best_rounds]


def test_cuts_are_quantiles(data):
    df, x, _, val, _ = data
    for got, column in zip(boosting.cut_points(df.filter("not _val"), "features", 4), x[~val].T):
        own = np.sort(column)
        assert got.tolist() == sorted({own[max(0, int(np.ceil((k + 1) / BINS * len(own) - 1e-9)) - 1)] for k in range(BINS - 1)})


def test_trees_do_not_depend_on_the_dealing(spark, data):
    df = data[0]
    before = boosting.fit(df, CASES[:2], "y")
    spark.conf.set("spark.chargeframe.fit.partitions", "3")
    try:
        again = boosting.fit(df.repartition(5), CASES[:2], "y")
    finally:
        spark.conf.unset("spark.chargeframe.fit.partitions")
    for a, b in zip(before, again):
        assert (a.model.feature == b.model.feature).all() and (a.model.threshold == b.model.threshold).all()
        assert np.allclose(a.model.value, b.model.value, atol=1e-5)


def test_flat_scores_equal_tree_by_tree(spark, data, tmp_path):
    df, x, *_ = data
    model = boosting.fit(df, [Settings(25, 0.2, leaves=9, min_rows=4)], "y")[0].model

    def by_hand(row):
        total = model.base
        for k in model.roots:
            while model.feature[k] >= 0:
                k = model.left[k] if row[model.feature[k]] <= model.threshold[k] else model.right[k]
            total += model.rate * model.value[k]
        return total

    assert model.predict(x) == pytest.approx([by_hand(r) for r in x])
    got = {tuple(r["features"]): r["prediction"] for r in model.transform(df).collect()}
    assert all(got[tuple(r)] == pytest.approx(by_hand(r)) for r in x)
    model.table(spark).write.parquet(str(tmp_path / "m"))
    again = ensemble.Ensemble.of(spark.read.parquet(str(tmp_path / "m")))
    assert (again.predict(x) == model.predict(x)).all() and again.rounds == 25
    assert (again.first(4).predict(x) == model.first(4).predict(x)).all()


def test_plans_do_not_grow_with_rounds(spark, data):
    df, x, *_ = data
    one = boosting.fit(df, [Settings(2, 0.2, depth=3)], "y")[0].model
    trees = [{"feature": one.feature[:int(one.roots[1])], "threshold": one.threshold[:int(one.roots[1])], "left": one.left[:int(one.roots[1])],
              "right": one.right[:int(one.roots[1])], "value": one.value[:int(one.roots[1])], "rows": one.rows[:int(one.roots[1])]}] * 1500
    many = ensemble.build(0.0, 0.01, trees)
    size = [len(m.transform(df)._jdf.queryExecution().toString()) for m in (one, many)]
    assert abs(size[0] - size[1]) < 50
    assert many.transform(df).agg(F.avg("prediction")).first()[0] == pytest.approx(many.predict(x).mean())


def test_few_rows_and_constants(spark):
    rows = spark.createDataFrame([([1.0, 2.0], 3.0, False)] * 4, "features array<double>, y double, _val boolean")
    got = boosting.fit(rows, [Settings(3, 0.5, min_rows=1), Settings(3, 0.5, alpha=0.5, min_rows=1)], "y")
    for g in got:
        assert g.model.rounds == 3 and g.model.predict(np.array([[1.0, 2.0]])).tolist() == [3.0]
    with pytest.raises(ValueError):
        boosting.fit(rows.limit(0), [Settings(1, 0.1)], "y")
    none = ensemble.Ensemble.of(ensemble.build(1.5, 0.1, []).table(spark))
    assert none.rounds == 0 and none.predict(np.zeros((2, 1))).tolist() == [1.5, 1.5]
