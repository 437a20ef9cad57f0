from __future__ import annotations

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from chargeframe.llm import bpe, fertility, packing, wordbpe
from chargeframe.llm.wordbpe import WordEncoder, encoder
from tests.llm import brute
from tests.llm.conftest import ROWS, SF

TOKENIZER = encoder().tokenizer
TEXT = st.lists(st.one_of(
    st.text("abcdt'sre ,.!1é", max_size=12), st.sampled_from(["<|endoftext|>", "<|", "日本語", "😀", "é̈", "각", " ", "İ", "Σ", "\x1c", " "])),
    max_size=12).map("".join)


def _ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_table_equals_the_library(text):
    ids, decoded = encoder().encode_and_decode(text)
    assert ids == brute.ids_bytes(_ids(text)) == encoder().encode(text)
    assert decoded == TOKENIZER.decode(_ids(text), skip_special_tokens=False)


class _Counting:
    """A tokenizer that notes the words its model is asked for."""

    def __init__(self, tokenizer):
        self.model, self.own, self.asked = self, tokenizer.model, []

    def tokenize(self, word):
        self.asked.append(word)
        return self.own.tokenize(word)


@pytest.mark.parametrize("decoding", [False, True])
def test_a_frequent_word_is_encoded_once_though_the_table_fills(decoding):
    code = WordEncoder(cache_words=12)
    counting = code.tokenizer = _Counting(code.tokenizer)
    texts = ["common " + " ".join(f"{a}{b}" for b in "xyz") for a in "abcdefgh"]
    for text in texts:
        assert (code.encode_and_decode(text)[0] if decoding else code.encode(text)) == brute.ids_bytes(_ids(text))
        assert len(code._ids) + len(code._old_ids) <= 12
    assert counting.asked.count("common") == 1 and len(counting.asked) == 1 + 3 * len(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x260), max_size=6) | st.text("<|a\x00\x7f\n é", max_size=4))
def test_plain_texts_are_those_without_other_characters(text):
    assert wordbpe._is_plain(text) == (not wordbpe._OTHER.search(text))


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 20), st.integers(1, 8))
@example("a" * 500, 7, 1)
@example("ababab" * 50 + "<|endoftext|>" * 3, 5, 2)
def test_tree_concatenation_is_exact(text, leaf, window):
    assert bpe.tree_encode(TOKENIZER, text, leaf, window) == _ids(text)


def test_encode_in_place_and_by_leaves(docs):
    """A leaf of 100 characters sends the long rows through the tree, repeated rows and all."""
    for leaf in (bpe.LEAF, 100):
        got = sorted([(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(docs, leaf=leaf).collect()], key=str)
        want = sorted([(i, len(_ids(t)), brute.sha(brute.ids_bytes(_ids(t))), brute.sha(TOKENIZER.decode(
            _ids(t), skip_special_tokens=False).encode())) for i, t in ROWS], key=str)
        assert got == want


def test_full_output_round_trip(docs):
    for r in bpe.encode(docs, leaf=100, full=True).filter("doc_id in (9, 11)").collect():
        text = dict(ROWS)[r["doc_id"]]
        assert bytes(r["ids"]) == brute.ids_bytes(_ids(text)) and r["decoded"] == TOKENIZER.decode(_ids(text), skip_special_tokens=False)


def _check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity, lane", [(4096, 16384), (64, 3)])
def test_packing(docs, capacity, lane):
    rows = packing.pack(docs, capacity=capacity, lane=lane).collect()
    want = sorted([(i, *p) for i, t in ROWS for p in brute.pieces([*_ids(t), 1], capacity)], key=str)
    assert sorted([tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows], key=str) == want
    n = _check_sequences(rows, capacity)
    assert n <= 1.1 * sum(r["length"] for r in rows) / capacity + 2


def test_sequences_hold_the_documents(docs):
    out = packing.sequences(packing.pack(docs, capacity=64, with_ids=True)).collect()
    pieces = {}
    for s in out:
        ids = np.frombuffer(bytes(s["ids"]), "<u4")
        assert len(ids) == s["n_tokens"] <= 64
        for p in s["pieces"]:
            pieces.setdefault(p["doc_id"], {})[p["piece"]] = ids[p["offset"]:]
    assert pieces[11][0][:len(_ids(ROWS[11][1]))].tolist() == _ids(ROWS[11][1])


def test_sum_of_squares_rule():
    """Each choice against the sum of squares itself."""
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 17, 300).tolist()
    bins, offsets = packing.sum_of_squares(lengths, 16)
    fill = {}
    for s, b, o in zip(lengths, bins, offsets):
        def cost(gap):
            counts = np.bincount([16 - v for v in fill.values() if v < 16], minlength=17)
            if gap < 16:
                counts[gap] -= 1
            if gap > s:
                counts[gap - s] += 1
            return int((counts ** 2).sum())
        gaps = {16 - v for v in fill.values() if 16 - v >= s}
        chosen = 16 - fill.get(b, 0)
        assert fill.get(b, 0) == o
        assert cost(chosen) == min(cost(g) for g in gaps | {16})
        fill[b] = o + s
    assert max(fill.values()) <= 16


def test_packing_nothing(none):
    assert packing.pack(none).collect() == [] and bpe.encode(none).collect() == [] and fertility.rate(none).collect() == []
    assert fertility.keep(none).collect() == []


def test_quality_counts(docs, spark):
    rows = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
            for r in fertility.rate(docs).collect()}
    assert rows == {(i, *(q := brute.quality(t)), q[0] < 10 or 100 * q[4] > 20 * q[0]) for i, t in ROWS}
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = fertility.rate(documents).collect()
    assert len(got) == documents.count() and not any(r["kept"] and r["base_failed"] for r in got)
    kept = fertility.keep(documents)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "\n", " \t", "#x", "é"]), max_size=60).map(" ".join))
def test_quality_of_repetitive_texts(text):
    assert fertility.base_counts(text, text.encode().split()) == brute.quality(text)


def test_bands_reject_encoded_data_and_keep_prose(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rated = fertility.rate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id")
    good = rated.filter("quality = 1 and not base_failed").selectExpr("avg(cast(kept as int)) k").first()["k"]
    assert good == 1.0
    rng = np.random.default_rng(1)
    chat = " ".join("ab" for _ in range(400))
    noise = " ".join("".join(chr(int(c)) for c in rng.integers(0x2800, 0x28FF, 12)) for _ in range(60))
    rows = [(1, chat), (2, noise), (3, "正しい文章です。" * 3 + "日本語の文を読むことができます。今日は天気がよいので外へ行きましょう 。 a b c d e f g h i j")]
    got = {r["doc_id"]: (r["script"], in_band(r)) for r in fertility.rate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("latin", False) and got[3] == ("cjk", True)


def in_band(r):
    return fertility.in_band(fertility.BANDS[r["script"]], r["chars_per_token"], r["byte_share"], r["entropy"], r["n_tokens"])
