from __future__ import annotations

import re
from pathlib import Path

import pytest

from chargeframe.llm import exactdedup, fertility, memory, neardup, packing


def _mb():
    held = re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
    return sum(map(int, held)) / 1024


def _between(batches):
    """Frees many buffers below one that stays, as tables of a task do."""
    for n in batches:
        held = [bytearray(b"x" * 1000) for _ in range(n)]
        pins.append(held[-1])
        del held
        yield n


pins: list = []


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_freed_memory_goes_back_before_the_next_batch():
    before = _mb()
    assert list(memory.releasing(_between)([60_000, 60_000])) == [60_000, 60_000]
    assert _mb() - before < 20


def test_memory_goes_back_when_a_reader_stops_early(monkeypatch):
    calls = []
    monkeypatch.setattr(memory, "release", lambda: calls.append(1))
    rows = memory.releasing(lambda batches: (b for b in batches))(iter([1, 2, 3]))
    assert (next(rows), next(rows), len(calls)) == (1, 2, 1)
    rows.close()
    assert len(calls) == 2


def test_python_stages_of_the_pipeline_give_memory_back(spark, monkeypatch):
    """Each Python pass of the stages that read whole texts is wrapped."""
    wrapped = []
    for module in (exactdedup, fertility, neardup, packing):
        monkeypatch.setattr(module, "releasing", lambda run: wrapped.append(run.__qualname__.split(".")[0]) or memory.releasing(run))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    fertility.keep(docs).collect()
    exactdedup.groups(docs).collect()
    neardup.groups(docs).collect()
    packing.pack(docs).collect()
    assert {"keep", "_local", "_bucket", "_scan", "_sets", "_likely", "_linked", "_blocks", "_cut"} <= set(wrapped)
