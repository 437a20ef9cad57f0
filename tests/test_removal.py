"""The library without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from chargeframe.registry import collect

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *(q for q in e.queries() if q.startswith('op') or q == 'pipeline'))"


def _copy(to: Path, *left_out: str) -> Path:
    """The library and its tests, without the paths left out."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "check.py", "chargeframe", "tests"):
        source = ROOT / name
        if name in left_out or not source.exists():
            continue
        if source.is_dir():
            shutil.copytree(source, to / name, ignore=lambda folder, names: [
                n for n in names if n == "__pycache__" or str((Path(folder) / n).relative_to(ROOT)) in left_out])
        else:
            shutil.copy(source, to / name)
    return to


@pytest.mark.parametrize("left_out", [("chargeframe/llm", "tests/llm", "corpus_pipeline.py"), ("chargeframe/llm", "tests/llm")])
def test_queries_without_the_corpus_operators(tmp_path, left_out):
    copy = _copy(tmp_path, *left_out)
    said = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)},
                          capture_output=True, text=True, timeout=120)
    queries, oracle = collect()
    assert said.stdout.split() == [str(len(queries)), str(len(oracle))], said.stderr
    found = subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=copy,
                           capture_output=True, text=True, timeout=120)
    assert found.returncode == 0 and "error" not in found.stdout.lower(), found.stdout


def test_queries_of_the_library_are_always_there():
    assert set(collect()[0]) <= set(entry.queries())
