from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chargeframe.llm import signatures
from chargeframe.llm.queries import ORACLE
from check import compare
from tests.llm import brute
from tests.llm.conftest import ROWS, SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(brute.LOWER))


def ranked(docs, items, top=20):
    """(item_id, rank, doc_id, score) of every item, from all documents."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:top], 1)]
    return out


ITEMS = [(1, "a b c D"), (2, "w7 w14 W7 text"), (3, None), (4, ""), (5, "nothing-of-this"), (1, "é ü 日本語 password"), (None, "x X x"), (6, " ".join(f"w{i}" for i in range(1013)))]


def _got(spark, docs, items, **more):
    queries = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS rank", "3 AS score")
    return sorted((tuple(r) for r in signatures.search(docs, queries, **more).collect()), key=str)


def test_ranks_against_all_pairs(spark, docs):
    assert _got(spark, docs, ITEMS) == sorted(ranked(ROWS, ITEMS), key=str)
    assert _got(spark, docs, ITEMS, top=2) == sorted(ranked(ROWS, ITEMS, 2), key=str)


def test_passes_and_small_blocks_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()][:12]
    want = sorted(ranked([tuple(r) for r in docs.select("doc_id", "text").collect()], items), key=str)
    assert _got(spark, docs, items) == want
    monkeypatch.setattr(signatures, "PASS_TERMS", 100)
    assert _got(spark, docs, items) == want


def test_agrees_with_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = signatures.search(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert compare(got.toPandas(), con.execute(ORACLE["op13_bitsliced_search"]).fetchdf()) == ""


def test_nothing_to_search(spark, docs, none):
    assert _got(spark, none, ITEMS) == [] and _got(spark, docs, []) == []
    assert _got(spark, docs.filter("doc_id in (3, 4, 5)"), ITEMS) == []


def test_terms_of_long_texts_are_whole(monkeypatch):
    text = "Äb c1 " * 300 + "x" * 500 + " y"
    want = Counter(t.encode() for t in terms(text))
    monkeypatch.setattr(signatures, "STRETCH", 64)
    assert signatures.term_counts(text) == want and signatures.term_counts(None) == Counter()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from([f"t{i}" for i in range(60)]), max_size=80), min_size=1, max_size=40))
def test_bounds_are_never_below_scores(texts):
    """Blocks as the index makes them, and the bounds of every document against its exact score."""
    counts = [Counter(x.encode() for x in t) for t in texts]
    n, total = sum(map(bool, counts)), sum(sum(c.values()) for c in counts)
    if not n:
        return
    df = Counter(t for c in counts for t in c)
    hashes = signatures._Hashes()
    items = [(k, Counter(f"t{(7 * k + j) % 60}".encode() for j in range(20))) for k in range(5)]
    query = signatures.Query(items, n, total, {int(h): df[t] for t, h in zip(df, hashes.of(df))})
    shelf = signatures._Shelf(8)  # far too few slices, so that bitmaps overlap
    own = [c for c in counts if c]
    for k, c in enumerate(own):
        shelf.add(k, sum(c.values()), hashes.of(c), np.array(list(c.values())))
    ids, lengths, m, bits = shelf.block()
    bound = query.bounds(np.array(lengths), m, np.frombuffer(bits, np.uint8).reshape(m, -1))
    for k in ids:
        for item, score in query.score(own[k], list(range(5))):
            assert bound[item, k] >= score
