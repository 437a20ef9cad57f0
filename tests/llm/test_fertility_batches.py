"""Measures of whole batches against the three libraries on each whole text."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chargeframe.llm import fertility
from chargeframe.llm.wordbpe import vocabulary_path
from tests.llm import brute

PARTS = ["a", "the", "ing", "Foo", " ", " ", "  ", "\n", "\t", "\r\n", "\x7f", "é", "́", "日本", "😀", "<|endoftext|>", "\x00", "\xa0", "\x85", "\x1c", "\x1f",
         "　", "▁", "'s", "1!", "12 34", "ΑΣ", "Привет", "İ", "ﬁ"]
WORDS = Tokenizer.from_file(vocabulary_path())
WORDS.no_truncation()


def _plain(ids, is_part, n_chars):
    counts = Counter(ids)
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values())
    return n_chars / len(ids), sum(bool(is_part[i]) for i in ids) / len(ids), entropy, len(ids)


def _measure(meter, text, n_chars):
    if not n_chars:
        return (None, None, None, 0, None, None, None, 0, None)
    words = len(WORDS.encode(text, add_special_tokens=False).ids)
    return (*_plain(meter.vocabulary.encode_ordinary(text), meter.is_part, n_chars), *_plain(meter.pieces.encode(text), meter.is_byte, n_chars),
            n_chars / words if words else None)


def _check(texts):
    meter = fertility._meter(None)
    for text, row in zip(texts, fertility._judge_all(texts, meter, fertility.BANDS), strict=True):
        counts = brute.quality(text or "")
        assert row[:5] == counts
        assert list(row[8:]) == [pytest.approx(x) for x in _measure(meter, text or "", counts[1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), min_size=1, max_size=6))
@example(["", " ", "\n"])
@example(["a ▁ b", "▁", " a", "a ", "a  b", "a \n b"])
@example(["one two three four five", "one two three four five", "one two three four five one two three four five"])
def test_batches_measure_as_the_libraries_do_on_whole_texts(texts):
    _check(texts)


def test_a_full_table_of_stretches_starts_anew(monkeypatch):
    monkeypatch.setattr(fertility, "CACHE_STRETCHES", 50)
    for k in range(5):
        _check([f"word{k}{i} and another{i} of them, " + "x" * 60 * (i % 3) + " end" for i in range(30)])


def test_long_texts_and_cuts_of_a_batch(monkeypatch):
    texts = ["some words of a text " * 3, None, "a long line of other words " * 50, "", "tail of the batch with ten words in it, or more"]
    whole = fertility._judge_all(texts, fertility._meter(None), fertility.BANDS)
    for characters in (1, 70, 200):
        monkeypatch.setattr(fertility, "CHARACTERS", characters)
        assert fertility._judge_all(texts, fertility._meter(None), fertility.BANDS) == whole
    _check(texts)
