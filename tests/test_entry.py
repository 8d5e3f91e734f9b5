"""The driver's entry with and without the folders for training data."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LLM = ("pairwright/llm", "tests/llm", "corpus_pipeline.py")


@pytest.mark.parametrize("gone", [LLM, LLM[:2], LLM[2:]])
def test_entry_imports_without(tmp_path, gone):
    """With all of them away, with the pipeline left behind, and with the pipeline away alone."""
    away = shutil.ignore_patterns(".git", "__pycache__", *(Path(g).name for g in gone))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=away)
    code = (
        "import __spark_entry__ as e; n = sorted(e.queries()); assert set(e.oracle_sql()) <= set(n); print(*n)"
    )
    out = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, check=True
    )
    names = set(out.stdout.split())
    assert {"roc_auc", "paired_bootstrap_ci", "random_forest"} <= names and len(names) > 90
    kept = "pairwright/llm" not in gone and (ROOT / "pairwright/llm").is_dir()
    assert any(n.startswith("op1_") for n in names) == kept
    assert ("pipeline" in names) == (kept and "corpus_pipeline.py" not in gone)
