"""What one pass sums up, without Spark."""

from __future__ import annotations

import numpy as np
import pytest

from chargeframe.operators import boosting as B
from chargeframe.operators.boosting import BINS, UNIT, Model, Settings


def block_of(n=3000, features=4, seed=1):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, BINS, (features, n)).astype(np.int8)
    y = bins[0] / 9 + (bins[1] > 30) * bins[2] / 20 + rng.normal(size=n)
    return {"bins": bins, "y": y, "train": n * 4 // 5, "uid": rng.integers(0, 2 ** 63, n).astype(np.uint64), "f": np.full((1, n), y.mean())}


def walked(tree, row):
    k = 0
    while tree["feature"][k] >= 0:
        k = tree["left"][k] if row[tree["feature"][k]] <= tree["bin"][k] else tree["right"][k]
    return k


def grow(block, s):
    """The passes of one tree: the nodes asked for and not known, per pass, and the model."""
    model, asked = Model(s, float(block["f"][0, 0])), []
    B._start_round(model, len(block["bins"]))
    while model.state == "split":
        ask = B._ask(model, 0)
        asked.append((len(ask[3]), sum(not x.known for x in model.nodes)))
        B._learn_splits(model, [x for x in next(B._passing([ask], 1)([block])) if x is not None], len(block["bins"]))
        if not B._grown(model)[1]:
            model.state = "leaves"
    return model, asked


@pytest.mark.parametrize("alpha", [None, 0.3])
def test_one_of_two_siblings_is_summed(alpha):
    block = block_of()
    model, asked = grow(block, Settings(1, 0.3, depth=5, min_rows=5, alpha=alpha))
    assert asked[0] == (1, 1) and len(asked) == 5
    assert all(2 * a == unknown for a, unknown in asked[1:])
    tree, order = B._tree_of(model.nodes, B._grown(model)[0])
    train, f = block["train"], block["f"][0]
    ends = [walked(tree, row) for row in block["bins"].T]
    assert B.place(tree, block["bins"]).tolist() == ends
    g = B.gradients(block["y"][:train], f[:train], alpha)
    for at, k in enumerate(order):
        if tree["feature"][at] < 0:
            own = np.array(ends[:train]) == at
            assert model.nodes[k].count == own.sum()
            assert model.nodes[k].total * UNIT == pytest.approx(g[own].sum(), abs=1)


def test_residuals_of_leaves_over_blocks(monkeypatch):
    blocks = [block_of(700, seed=i) for i in range(5)]
    model, _ = grow(block_of(), Settings(1, 0.3, leaves=6, alpha=0.3))
    tree, _ = B._tree_of(model.nodes, B._grown(model)[0])
    rest, ends = [], []
    for b in blocks:
        rest.append((b["y"] - b["f"][0])[:b["train"]])
        ends.append(B.place(tree, b["bins"], b["train"]))
    rest, ends = np.concatenate(rest), np.concatenate(ends)
    monkeypatch.setattr(B, "POINTS", 10_000)
    for together in (2, 8):
        monkeypatch.setattr(B, "TOGETHER", together)
        found = next(B._passing([("leaves", Settings(1, 0.3, alpha=0.3), tree)], 1)(blocks))[0]
        assert sorted(found) == sorted(set(ends))
        assert all((found[k][0] == np.sort(rest[ends == k])).all() and found[k][1].sum() == (ends == k).sum() for k in found)


def test_trees_are_added_once():
    block = block_of()
    model, _ = grow(block, Settings(1, 0.3, depth=3))
    B._finish_tree(model, None)
    new = B._advanced(block, [(0.3, model.trees)])
    want = block["f"][0] + 0.3 * model.trees[0]["value"][[walked(model.trees[0], row) for row in block["bins"].T]]
    assert new["f"][0] == pytest.approx(want, rel=1e-12) and (B._advanced(new, [(0.3, [])])["f"] == new["f"]).all()
