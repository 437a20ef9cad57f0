"""Gradient boosting over histograms, trees grown best-first, several models in step.

Features are put into bins once; the binned rows live in blocks that stay in the executors, feature by feature and training
rows first, with the running prediction of every model; the first pass of a round adds the last trees to these and keeps
the blocks anew. One pass over the blocks serves all models: it sums gradients per (node, feature, bin)
for the nodes that each model asks for, and the errors of the last round. Of two siblings only the one with fewer rows is
summed up, the other is what it leaves of the parent. Gradients are whole multiples of 2 ** -20, so the
sums, and with them the trees, do not depend on how rows are dealt. What reaches the driver is bounded by the
nodes of the trees under way, the features and the bins, never by the rows.

Best-first growth splits the leaf of the largest gain until the leaf limit. A pass looks at the children of all leaves
that could still be split, so a tree takes about as many passes as it has levels and equals the one grown leaf by leaf.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeframe.operators import ensemble
from chargeframe.runtime import durable_spread, materialize, shared_dir

#: Bins per feature, and rows per block.
BINS, BLOCK = 64, 65_536
#: Gradients are multiples of 1 / UNIT.
UNIT = 1 << 20
#: Rounds after which the blocks are written to the shared folder, which cuts their lineage.
FOLD_IN = 16
#: Points that a leaf's residuals are summarised by, per partition; exact below.
POINTS = 512
#: Blocks whose residuals are sorted together.
TOGETHER = 8
#: Partitions whose results the driver adds up itself; beyond, they are added up in the executors first.
DIRECT = 64


@dataclass(frozen=True)
class Settings:
    """``leaves`` and ``depth`` limit a tree (None: no limit); ``rows`` and ``columns`` are the shares that a
    tree sees; ``patience`` is the number of rounds without gain that end the fit; with ``alpha`` the loss is that quantile's."""

    rounds: int
    rate: float
    leaves: int | None = None
    depth: int | None = None
    min_rows: int = 20
    l1: float = 0.0
    l2: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    patience: int | None = None
    alpha: float | None = None
    seed: int = 42


@dataclass
class Node:
    path: tuple
    total: float = 0.0
    count: int = 0
    split: tuple | None = None  # gain, feature, bin, and what goes left: gradient and rows
    known: bool = False
    children: tuple = ()
    sums: tuple | None = None  # gradients and rows by (feature, bin), until the children's are known


@dataclass
class Model:
    """A model under way: finished trees, the nodes of the tree under way, and the errors per round."""

    settings: Settings
    base: float
    trees: list = field(default_factory=list)
    folded: int = 0
    nodes: list = field(default_factory=list)
    columns: np.ndarray | None = None
    history: list = field(default_factory=list)
    best: float = float("inf")
    best_rounds: int = 0
    done: bool = False
    state: str = "measure"


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def sampled(uid: np.ndarray, share: float, seed: int, round_: int) -> np.ndarray:
    """Rows that a round sees."""
    return _mixed(uid, seed * 1_000_003 + round_ + 1) < np.uint64(min(share, 1 - 2.0 ** -53) * 2.0 ** 64)


def place(tree: dict, bins: np.ndarray, rows: int | None = None) -> np.ndarray:
    """The node each of the first rows of ``bins`` (features, rows) ends in."""
    feature, at = tree["feature"], np.arange(len(tree["feature"]))
    inner, rows = feature >= 0, bins.shape[1] if rows is None else rows
    # leaves lead to themselves, so that all rows walk as many steps as the tree is deep
    cut = np.where(inner, tree["bin"], BINS).astype(np.int8)
    start = np.where(inner, feature, 0).astype(np.int64) * bins.shape[1]
    child = np.stack([np.where(inner, tree["left"], at), np.where(inner, tree["right"], at)], axis=1).ravel().astype(np.int64)
    flat, own, node, reached = bins.ravel(), np.arange(rows), np.zeros(rows, np.int64), np.zeros(1, np.int64)
    to, of, limit = np.empty(rows, np.int64), np.empty(rows, np.int8), np.empty(rows, np.int8)
    while inner[reached].any():
        # clipping cannot happen; with it, numpy writes into the given arrays without a copy
        np.add(start.take(node, out=to, mode="clip"), own, out=to)
        right = flat.take(to, out=of, mode="clip") > cut.take(node, out=limit, mode="clip")
        node <<= 1
        node += right
        node = child.take(node, mode="clip")
        reached = np.unique(child.reshape(-1, 2)[reached])
    return node


def _advanced(block: dict, new: list) -> dict:
    """The block with the models' new trees added to the running predictions (models, rows)."""
    f = block["f"].copy()
    for own, (rate, trees) in zip(f, new):
        for t in trees:
            own += rate * t["value"].take(place(t, block["bins"]))
    return {**block, "f": f}


def gradients(y: np.ndarray, f: np.ndarray, alpha: float | None) -> np.ndarray:
    """Of the loss by the prediction, in units."""
    g = f - y if alpha is None else np.where(y > f, -alpha, 1 - alpha)
    return np.rint(g * UNIT)


def _errors(block: dict, f: np.ndarray, alpha: float | None) -> np.ndarray:
    """Per role (train, validation): rows, sums of |error|, error squared, pinball loss, label and its square."""
    out = np.zeros((2, 6))
    for role, own in enumerate((slice(None, block["train"]), slice(block["train"], None))):
        y, e = block["y"][own], block["y"][own] - f[own]
        pin = np.maximum((alpha or 0.5) * e, ((alpha or 0.5) - 1) * e)
        out[role] = len(y), np.abs(e).sum(), (e * e).sum(), pin.sum(), y.sum(), (y * y).sum()
    return out


def _histograms(block: dict, f: np.ndarray, s: Settings, tree: dict, wanted: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and numbers of training rows by (wanted node, feature, bin)."""
    bins, train, count = block["bins"], block["train"], len(wanted)
    slot = np.full(len(tree["feature"]), -1)
    slot[wanted] = np.arange(count)
    slot = slot.take(place(tree, bins, train))
    seen = slot >= 0
    if s.rows < 1:
        seen &= sampled(block["uid"][:train], s.rows, s.seed, round_)
    at = None if seen.all() else np.flatnonzero(seen)
    own = lambda a: a[:train] if at is None else a.take(at)
    y, now, slot = own(block["y"]), own(f), own(slot)
    g, n = np.empty((2, count, len(bins), BINS), np.int64)
    if s.alpha is None:
        start, weights = slot * BINS, gradients(y, now, None)
        for j, of in enumerate(bins):
            to = start + own(of)
            g[:, j] = np.bincount(to, weights, count * BINS).reshape(count, BINS)
            n[:, j] = np.bincount(to, minlength=count * BINS).reshape(count, BINS)
    else:
        # there are two gradients only: the rows of each are counted
        low, high = gradients(np.array([1.0, 0.0]), np.zeros(2), s.alpha).astype(np.int64)
        start = (2 * slot + (y > now)) * BINS
        for j, of in enumerate(bins):
            over = np.bincount(start + own(of), minlength=2 * count * BINS).reshape(count, 2, BINS)
            g[:, j] = over[:, 0] * high + over[:, 1] * low
            n[:, j] = over[:, 0] + over[:, 1]
    return g.ravel(), n.ravel()


def _by_leaf(parts: list[tuple[np.ndarray, np.ndarray]], leaves: int) -> dict:
    """Residuals of several blocks, each with the leaves of its rows, as sorted values per leaf with their weights."""
    leaf, rest = (np.concatenate(own) for own in zip(*parts))
    order = np.argsort(leaf.astype(np.min_scalar_type(leaves)), kind="stable")
    ends = np.cumsum(np.bincount(leaf, minlength=leaves))
    return {k: (np.sort(own), np.ones(len(own))) for k, own in enumerate(np.split(rest.take(order), ends[:-1])) if len(own)}


def _summary(values: np.ndarray, weights: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``points`` values for the sorted weighted values, each standing for the ones up to it."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    if len(values) <= points:
        return values, weights
    upto = np.cumsum(weights)
    at = np.unique(np.searchsorted(upto, np.ceil(np.arange(1, points + 1) * upto[-1] / points)))
    return values[at], np.diff(upto[at], prepend=0)


def _passing(asks: list, models: int):
    """One pass over a partition's blocks. ``asks`` has per model, once or twice over: None, ("measure", settings), ("split", settings, tree, wanted
    nodes, round) or ("leaves", settings, tree)."""
    def run(blocks):
        found: list = [None] * len(asks)
        waiting: list = [[] for _ in asks]

        def sort(m: int) -> None:
            if waiting[m]:
                found[m] = _joined(found[m], _by_leaf(waiting[m], len(asks[m][2]["feature"])))
                waiting[m] = []

        for block in blocks:
            for m, ask in enumerate(asks):
                if ask is None:
                    continue
                kind, s = ask[:2]
                f = block["f"][m % models]
                if kind == "measure":
                    own = _errors(block, f, s.alpha)
                    found[m] = own if found[m] is None else found[m] + own
                elif kind == "leaves":
                    train = block["train"]
                    waiting[m].append((place(ask[2], block["bins"], train), block["y"][:train] - f[:train]))
                    if len(waiting[m]) == TOGETHER:
                        sort(m)
                elif block["train"]:
                    g, n = _histograms(block, f, s, *ask[2:])
                    found[m] = (g, n) if found[m] is None else (found[m][0] + g, found[m][1] + n)
        for m, ask in enumerate(asks):
            sort(m)
            if ask is not None and ask[0] == "split" and found[m] is not None:
                there = np.flatnonzero(found[m][1])
                found[m] = (there, found[m][0][there], found[m][1][there])
        yield found
    return run


def _joined(a: dict | None, b: dict | None) -> dict:
    """Summaries of residuals per leaf put together."""
    out = dict(a or {})
    for k, (values, weights) in (b or {}).items():
        old = out.get(k, (np.zeros(0), np.zeros(0)))
        out[k] = _summary(np.concatenate([old[0], values]), np.concatenate([old[1], weights]), POINTS)
    return out


def _added(a: list, b: list) -> list:
    """The results of two partitions."""
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(y if x is None else x)
        elif isinstance(x, dict):
            out.append(_joined(x, y))
        elif isinstance(x, tuple):
            at, place_ = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
            g, n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            np.add.at(g, place_, np.concatenate([x[1], y[1]]))
            np.add.at(n, place_, np.concatenate([x[2], y[2]]))
            out.append((at, g, n))
        else:
            out.append(x + y)
    return out


def _pass(blocks: RDD, asks: list, models: int) -> list:
    found = blocks.mapPartitions(_passing(asks, models))
    if blocks.getNumPartitions() > DIRECT:
        return found.treeReduce(_added, depth=2)
    parts = found.collect()
    return [list(filter(None, own)) if any(isinstance(x, tuple) for x in own) else reduce(lambda a, b: _added([a], [b])[0], own)
            for own in zip(*parts)]


def _shrunk(g, s: Settings):
    return np.sign(g) * np.maximum(np.abs(g) - s.l1, 0)


def best_split(g: np.ndarray, n: np.ndarray, columns: np.ndarray, s: Settings) -> tuple | None:
    """The split of the largest gain over (features, bins), the first of equal ones; None without a gain."""
    g = g / UNIT
    left, n_left = np.cumsum(g, axis=1), np.cumsum(n, axis=1)
    right, n_right = left[:, -1:] - left, n_left[:, -1:] - n_left
    least = max(1, s.min_rows)
    fits = (n_left >= least) & (n_right >= least) & columns[:, None]
    if not fits.any():
        return None
    worth = lambda a, c: _shrunk(a, s) ** 2 / np.maximum(c + s.l2, 1e-300)
    gain = np.where(fits, worth(left, n_left) + worth(right, n_right) - worth(left[:, -1:], n_left[:, -1:]), -np.inf)
    at = int(gain.argmax())
    feature, bin_ = divmod(at, g.shape[1])
    # a gain below the rounding of the sums is none
    return (float(gain.flat[at]), feature, bin_, float(left.flat[at]), int(n_left.flat[at])) if gain.flat[at] > 1e-9 else None


def _tree_of(nodes: list[Node], inner: set[int]) -> tuple[dict, list[int]]:
    """Arrays of the tree whose nodes in ``inner`` are split, and the nodes' numbers in the order of the arrays."""
    order, stack = [], [0]
    while stack:
        k = stack.pop()
        order.append(k)
        if k in inner:
            stack += reversed(nodes[k].children)
    at = {k: i for i, k in enumerate(order)}
    get = lambda k, f, other: f(nodes[k]) if k in inner else other
    tree = {"feature": np.array([get(k, lambda x: x.split[1], -1) for k in order]), "bin": np.array([get(k, lambda x: x.split[2], 0) for k in order]),
            "left": np.array([get(k, lambda x: at[x.children[0]], 0) for k in order]), "right": np.array([get(k, lambda x: at[x.children[1]], 0) for k in order]),
            "rows": np.array([float(nodes[k].count) for k in order])}
    return tree, order


def _divide(model: Model, k: int) -> None:
    """Adds a node's children; their sums follow from the split, their gain is unknown unless they are at the depth limit."""
    node, depth = model.nodes[k], model.settings.depth
    _, _, _, total, count = node.split
    node.children = (len(model.nodes), len(model.nodes) + 1)
    last = depth is not None and len(node.path) + 1 >= depth
    model.nodes += [Node((*node.path, 0), total, count, None, last), Node((*node.path, 1), node.total - total, node.count - count, None, last)]


def _grown(model: Model) -> tuple[set[int], list[int]]:
    """Nodes that best-first growth splits as far as gains are known, and leaves whose gain it has to know next."""
    s, nodes = model.settings, model.nodes
    inner: set[int] = set()
    limit = s.leaves or float("inf")
    leaves, open_, ready = 1, [], []

    def reach(k: int) -> None:
        if not nodes[k].known:
            open_.append(k)
        elif nodes[k].split:
            heapq.heappush(ready, (-nodes[k].split[0], len(nodes[k].path), nodes[k].path, k))

    reach(0)
    while leaves < limit:
        if open_:
            return inner, open_
        if not ready:
            break
        k = heapq.heappop(ready)[-1]
        if not nodes[k].children:
            _divide(model, k)
        inner.add(k)
        leaves += 1
        for child in nodes[k].children:
            reach(child)
    return inner, []


def _wanted(model: Model) -> list[tuple[int, int | None, int | None]]:
    """Nodes whose sums are looked for: the root, or of two children the one with fewer rows, with its sibling and parent."""
    nodes = model.nodes
    if not nodes[0].known:
        return [(0, None, None)]
    pairs = [(k, x.children) for k, x in enumerate(nodes) if x.children and not nodes[x.children[0]].known]
    return [(a, b, k) if nodes[a].count <= nodes[b].count else (b, a, k) for k, (a, b) in pairs]


def _ask(model: Model, round_: int) -> tuple | None:
    """What the model needs from the next pass."""
    if model.state == "measure":
        return ("measure", model.settings)
    if model.state == "split":
        # every node with a known split may turn out to be split: look at all its unknown children at once
        reach = [k for k, x in enumerate(model.nodes) if x.children]
        tree, order = _tree_of(model.nodes, set(reach))
        at = {k: i for i, k in enumerate(order)}
        return ("split", model.settings, tree, np.array([at[k] for k, _, _ in _wanted(model)]), round_)
    tree, _ = _tree_of(model.nodes, _grown(model)[0])
    return ("leaves", model.settings, tree)


def _learn_splits(model: Model, found: tuple | list | None, n_features: int) -> None:
    """Takes the sums of the wanted nodes, whole or per partition, and splits those that may be split and their siblings."""
    s, nodes, wanted = model.settings, model.nodes, _wanted(model)
    size = n_features * BINS
    g, n = np.zeros(len(wanted) * size, np.int64), np.zeros(len(wanted) * size, np.int64)
    for at, part_g, part_n in ([found] if isinstance(found, tuple) else found or []):
        g[at] += part_g
        n[at] += part_n
    for (k, sibling, parent), *own in zip(wanted, g.reshape(-1, n_features, BINS), n.reshape(-1, n_features, BINS)):
        nodes[k].sums = tuple(own)
        if parent is None:
            nodes[k].total, nodes[k].count = float(own[0][0].sum()) / UNIT, int(own[1][0].sum())
        else:
            nodes[sibling].sums = tuple(a - b for a, b in zip(nodes[parent].sums, own))
            nodes[parent].sums = None
        for node in (nodes[k], *([] if sibling is None else [nodes[sibling]])):
            node.known = True
            if s.depth is None or len(node.path) < s.depth:
                node.split = best_split(*node.sums, model.columns, s)
            if not node.split:
                node.sums = None
    # split ahead where growth may need it: as many of the largest gains as there can be splits
    ready = [k for k, x in enumerate(nodes) if x.split and not x.children]
    ready.sort(key=lambda k: -nodes[k].split[0])
    for k in ready[:s.leaves]:
        _divide(model, k)


def _finish_tree(model: Model, summaries: dict | None) -> None:
    s = model.settings
    tree, order = _tree_of(model.nodes, _grown(model)[0])
    if s.alpha is None:
        tree["value"] = np.array([float(-_shrunk(model.nodes[k].total, s) / max(model.nodes[k].count + s.l2, 1e-300)) for k in order])
    else:
        tree["value"] = np.zeros(len(order))
        for leaf, (values, weights) in (summaries or {}).items():
            upto = np.cumsum(weights)
            tree["value"][leaf] = values[np.searchsorted(upto, np.ceil(s.alpha * upto[-1]))]
    tree["value"] = np.where(tree["feature"] < 0, tree["value"], 0.0)
    model.trees.append(tree)
    model.nodes, model.state = [], "measure"


def _start_round(model: Model, n_features: int) -> None:
    s, round_ = model.settings, len(model.trees)
    rng = np.random.default_rng([s.seed, round_])
    model.columns = np.zeros(n_features, bool)
    model.columns[rng.choice(n_features, max(1, round(s.columns * n_features)), replace=False)] = True
    model.nodes, model.state = [Node(())], "split"


def _take_errors(model: Model, errors: np.ndarray) -> None:
    """Notes the errors after the last round, and whether the fit ends there."""
    s = model.settings
    model.history.append(errors)
    n, loss = errors[1, 0], errors[1, 2 if s.alpha is None else 3]
    if n == 0:
        model.best_rounds = len(model.trees)
    elif loss / n < model.best:
        model.best, model.best_rounds = loss / n, len(model.trees)
    stuck = s.patience is not None and n > 0 and len(model.trees) - model.best_rounds >= s.patience
    model.done = stuck or len(model.trees) >= s.rounds


def cut_points(data: DataFrame, vector: str, width: int) -> list[np.ndarray]:
    """At most BINS - 1 thresholds per feature: quantiles of the training rows, in one pass."""
    shares = [(k + 1) / BINS for k in range(BINS - 1)]
    row = data.agg(*(F.percentile_approx(F.get(vector, F.lit(i)), shares, 10_000).alias(f"q{i}") for i in range(width))).first()
    return [np.unique(np.array(row[i] if row[i] is not None else [], float)) for i in range(width)]


def _binned(cuts: list[np.ndarray], bases: list[float]):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                role = part.column(2).to_numpy(zero_copy_only=False)
                order = np.argsort(role, kind="stable")
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(cuts))[order]
                bins = np.stack([np.searchsorted(c, x[:, i], side="left").astype(np.int8) for i, c in enumerate(cuts)])
                block = {"bins": bins, "y": part.column(1).to_numpy(zero_copy_only=False)[order], "train": int((role == 0).sum()),
                         "uid": part.column(3).to_numpy(zero_copy_only=False).view(np.uint64)[order],
                         "f": np.repeat(np.array(bases)[:, None], part.num_rows, axis=1)}
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])
    return run


def _fold_in(blocks: RDD, models: list[Model], number: int) -> RDD:
    """Blocks whose running predictions have all finished trees, kept by the next pass over them."""
    new = [(m.settings.rate, m.trees[m.folded:]) for m in models]
    out = blocks.map(lambda block: _advanced(block, new)).persist(StorageLevel.MEMORY_AND_DISK)
    if number % FOLD_IN == 0:
        out.checkpoint()
    for m in models:
        m.folded = len(m.trees)
    return out


@dataclass
class Fitted:
    """A fitted model, its number of rounds before it was cut to the best, and the errors after 0, 1, … rounds."""

    model: ensemble.Ensemble
    best: float
    fitted_rounds: int
    history: list[np.ndarray]


def _exported(model: Model, cuts: list[np.ndarray]) -> ensemble.Ensemble:
    """Bins become thresholds; a bin beyond the last cut cannot be split at."""
    trees = [{**t, "threshold": np.array([cuts[f][b] if f >= 0 else 0.0 for f, b in zip(t["feature"], t["bin"])])} for t in model.trees[:model.best_rounds]]
    return ensemble.build(model.base, model.settings.rate, trees)


def fit(data: DataFrame, settings: list[Settings], label: str, features: str = "features", validation: str = "_val") -> list[Fitted]:
    """Models with these settings, fitted in step on rows with ``validation`` false; errors of the other rows end a fit.

    ``features`` is a vector or an array column without gaps. Without validation rows all rounds are run.
    """
    spark = data.sparkSession
    shared_dir(spark)
    vector = vector_to_array(features) if data.schema[features].dataType.typeName() != "array" else F.col(features).cast("array<double>")
    rows = data.select(vector.alias("x"), F.col(label).cast("double").alias("y"), F.col(validation).cast("int").alias("role"))
    rows = durable_spread(rows.withColumn("uid", F.xxhash64("x", "y")), "uid")
    train = rows.filter("role = 0")
    levels = sorted({s.alpha for s in settings if s.alpha is not None})
    start = train.agg(F.avg("y").alias("mean"), F.max(F.size("x")).alias("width"),
                      F.percentile_approx("y", [*levels, 0.5], 10_000).alias("q")).first()
    if start["mean"] is None:
        raise ValueError("no training rows")
    n_features = start["width"]
    bases = [float(start["mean"] if s.alpha is None else start["q"][levels.index(s.alpha)]) for s in settings]
    cuts = cut_points(train, "x", n_features)
    table = materialize(rows.mapInArrow(_binned(cuts, bases), "block binary"), "binned")
    blocks = table.rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    models = [Model(s, b) for s, b in zip(settings, bases)]
    folds, before = 0, None
    while not all(m.done for m in models):
        if any(len(m.trees) > m.folded for m in models):
            folds += 1
            before, blocks = blocks, _fold_in(blocks, models, folds)
        asks = [None if m.done else _ask(m, len(m.trees)) for m in models]
        starting = [ask is not None and ask[0] == "measure" for ask in asks]
        # the first pass of a round measures the last one: both see the same running prediction
        firsts = []
        for m, new in zip(models, starting):
            if new and len(m.trees) < m.settings.rounds:
                _start_round(m, n_features)
                firsts.append(_ask(m, len(m.trees)))
            else:
                firsts.append(None)
        found = _pass(blocks, [*asks, *firsts] if any(starting) else asks, len(models))
        if before is not None:
            before.unpersist()
            before = None
        for k, (m, ask) in enumerate(zip(models, asks)):
            if ask is None:
                continue
            if ask[0] == "measure":
                _take_errors(m, found[k])
                if m.done:
                    continue
                _learn_splits(m, found[len(models) + k], n_features)
            elif ask[0] == "split":
                _learn_splits(m, found[k], n_features)
            else:
                _finish_tree(m, found[k])
                continue
            if not _grown(m)[1]:
                if m.settings.alpha is None:
                    _finish_tree(m, None)
                else:
                    m.state = "leaves"
    blocks.unpersist()
    return [Fitted(_exported(m, cuts), m.best, len(m.trees), m.history) for m in models]
