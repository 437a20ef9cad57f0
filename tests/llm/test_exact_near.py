from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chargeframe.llm import exactdedup, keeping, neardup, shingles
from chargeframe.llm.components import components
from tests.llm import brute
from tests.llm.conftest import ROWS, SF


def _rows(df):
    return sorted([tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()], key=str)


def test_equal_texts_are_grouped(docs):
    got, want = _rows(exactdedup.groups(docs)), brute.exact_groups(ROWS)
    assert got == want


@pytest.mark.parametrize("table, bucket", [(1, 1 << 20), (2000, 500), (60_000, 10)])
def test_spilling_does_not_change_the_groups(docs, table, bucket):
    """Tables so small that texts spill over several levels and one filling has one text."""
    assert _rows(exactdedup.groups(docs, table_bytes=table, bucket_bytes=bucket)) == brute.exact_groups(ROWS)


def test_no_rows(none):
    assert exactdedup.groups(none).collect() == [] and neardup.groups(none).collect() == []
    assert exactdedup.groups(none).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_the_table_compares_contents():
    table = exactdedup.ContentTable(10_000)
    assert table.find_or_add(7, b"a") == (0, True) and table.find_or_add(7, b"b") == (1, True)
    assert table.find_or_add(7, b"a") == (0, False) and table.find_or_add(7, b"x" * 20_000) == (-1, False)
    for i in range(60):
        table.find_or_add(i * 1024, b"%d" % i)
    assert all(table.find_or_add(i * 1024, b"%d" % i)[1] is False for i in range(60))


def test_near_duplicates_of_the_edge_rows(docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.groups(docs).collect()}
    n = len(brute.shingles(ROWS[7][1]))
    assert {(1, 9, 1, True), (2, 9, 1, False), (None, 9, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
            (6, 1, 6, True), (7, 1, 6, False), (8, n, 8, True), (10, n, 8, False), (None, 0, None, True)} <= got
    assert (9, n + 1, 8, False) in got


def _variants():
    rng, rows, number = np.random.default_rng(5), [], 0
    for group in range(6):
        words = [f"g{group}w{i}" for i in range(60)]
        for _ in range(25):
            own = list(words)
            for at in rng.choice(60, int(rng.integers(0, 7)), replace=False):
                own[at] = f"new{rng.integers(1 << 30)}"
            rows.append((number, " ".join(own)))
            number += 1
    return rows


@pytest.mark.parametrize("block, split", [(2048, 8192), (7, 10), (7, 8192)])
def test_links_agree_with_all_pairs(spark, block, split):
    """Groups around the limit, where many members are not linked with the smallest one; blocks split the buckets."""
    rows = _variants()
    want = brute.near_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.groups(
        spark.createDataFrame(rows, "doc_id long, text string"), block=block, split=split).collect()}
    assert got == want


def test_documents_agree_with_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.near_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = neardup.groups(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_components_of_paths_and_rings(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aAbB \t\né日", max_size=30), min_size=1, max_size=6), st.integers(1, 5))
def test_hashed_shingles_count_like_the_plain_ones(texts, size):
    for text, found in zip(texts, shingles.shingle_sets([t.encode() for t in texts], size)):
        assert len(found) == len(brute.shingles(text, size))


def test_kept_rows(spark, docs):
    kept = keeping.keep_rows(docs, exactdedup.groups(docs), once=True)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    # null ids are one document: both texts stay, though one is also document 1
    want = [r for r in ROWS if r[0] in (1, 3, 5, 6, 7, 8, 9, 11, 12)] + [(None, ROWS[0][1]), (None, None)]
    assert [r for r in got if r[0] is not None] == sorted((r for r in want if r[0] is not None), key=str)


def test_rows_without_ids_meet_their_own_texts_only(spark, monkeypatch):
    """Many different texts share the null id: each is read for its own set, not for those of all others."""
    rows = [(None, f"text {i // 2} has these words and {i // 2 * 7} more of them" + " again" * (i % 2)) for i in range(600)]
    read, sets = spark.sparkContext.accumulator(0), neardup._sets

    def counted(size):
        run = sets(size)

        def each(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield from run([batch])
        return each

    monkeypatch.setattr(neardup, "_sets", counted)
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == 600 and got.filter("component_id is not null or not kept").isEmpty()
    assert 0 < read.value <= 600
