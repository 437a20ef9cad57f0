from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chargeframe.llm import balltree, codebooks
from chargeframe.llm.queries import ORACLE
from check import compare
from tests.llm.conftest import SF


def plain(rows, parts=8, entries=16, rounds=6):
    """Rows (vec_id, vector, label) to (vec_id, code, error, label_error) and the digest, point by point."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], y) for i, v, y in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(order[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[v[p * width:(p + 1) * width] for _, v, _ in order[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(near(p, v[p])[1], []).append(v[p])
            for e, own in groups.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = [[near(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    per_label = {}
    for (_, _, y), e in zip(kept, errors):
        per_label[y] = per_label.get(y, 0) + e
    out = [(i, "".join(f"{e:02x}" for _, e in f), d, per_label[y]) for (i, _, y), f, d in zip(kept, found, errors)]
    text = ",".join(str(x) for b in books for c in b for x in c)
    return sorted(out, key=str), hashlib.sha256(text.encode()).hexdigest()


def _rows(n, width, seed, step=0.25):
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(0, n)), [float(x) for x in np.round(rng.normal(size=width) / step) * step], int(rng.integers(0, 3)) or None) for _ in range(n)]


ODD = [(1, None, 1), (2, [1.0] * 15 + [None], 1), (3, [float("nan")] + [0.0] * 15, 1), (4, [float("inf")] + [0.0] * 15, 1),
       (None, [0.5] * 16, None), (0, [-0.5] * 16, 7), (0, [-0.5] * 16, 7), (0, [0.25] * 16, None), (9, [1e-5] * 16, 2)]
DDL = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("rows", [ODD, _rows(300, 16, 1) + ODD, _rows(60, 24, 2), ODD[6:8], _rows(100, 8, 5, 2.0)])
def test_codes_against_plain_rounds(spark, rows):
    table = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS code", "'x' AS x", "2 AS error")
    got = codebooks.compress(table, chunk=64).collect()
    want, digest = plain(rows)
    assert sorted((tuple(r)[:4] for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_nothing_to_compress(spark):
    assert codebooks.compress(spark.createDataFrame([], DDL)).collect() == []
    assert codebooks.compress(spark.createDataFrame([(1, None, 1)], DDL)).collect() == []
    odd = spark.createDataFrame([(1, [], 1), (2, [0.5], 1)], DDL)
    assert [tuple(r)[:4] for r in codebooks.compress(odd).collect()] == [(1, "00" * 8, 0, 0)]


def test_lengths_that_do_not_divide_are_padded(spark):
    rows = spark.createDataFrame([(i, [0.1 * i, 1.0, -0.5], 1) for i in range(30)] + [(99, [1.0] * 9, 1)], DDL)
    got = codebooks.compress(rows).collect()
    assert len(got) == 30 and all(r["code"].endswith("0000000000") for r in got)


def test_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = codebooks.compress(spark.read.parquet(f"{SF}/embeddings.parquet"), chunk=32)
    assert compare(got.toPandas(), con.execute(ORACLE["op11_anchor_codebooks"]).fetchdf()) == ""


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(1, 400), st.integers(1, 20), st.sampled_from([1, 5, 400]))
def test_trees_give_sums_and_labels_of_all_points(seed, n, k, spread):
    rng = np.random.default_rng(seed)
    points, entries = rng.integers(-spread, spread + 1, (n, 3)), rng.integers(-spread, spread + 1, (k, 3))
    tree = balltree.build(points, leaf=4)
    want = ((points[:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)
    assert (balltree.labels(tree, points, entries) == want).all()
    total, count = balltree.sums(tree, points, entries)
    assert (count == np.bincount(want, minlength=k)).all()
    assert (total == np.array([points[want == e].sum(axis=0) for e in range(k)])).all()


def test_balls_hold_their_points_and_most_are_not_looked_at():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = centres[rng.integers(0, 16, 4000)] + rng.integers(-90, 90, (4000, 8))
    tree = balltree.build(points)
    for low, high, pivot, radius, total in zip(tree.low, tree.high, tree.pivot, tree.radius, tree.total):
        own = points[tree.order[low:high]]
        assert ((own - pivot) ** 2).sum(axis=1).max() == radius and (own.sum(axis=0) == total).all()
    looked_at = sum(len(at) for _, balls, at in balltree.nearest(tree, points, centres) if balls is None)
    assert looked_at < 200
