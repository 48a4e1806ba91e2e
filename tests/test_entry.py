"""The driver's contract, with the corpus operators and without them."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_points

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_its_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_works_without_the_corpus_operators(tmp_path):
    for folder in ("runlens", "tests"):
        shutil.copytree(ROOT / folder, tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if (ROOT / "corpus_pipeline.py").exists():  # it stays in one case, and goes in the other
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    for _ in range(2):
        code = "import __spark_entry__ as e; q = e.queries(); assert 'run_deltas' in q and set(e.oracle_sql()) <= set(q); assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)"
        done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
