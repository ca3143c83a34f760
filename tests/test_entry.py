"""The entry without its optional parts: in a copy, by another interpreter."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without_optional_parts(tmp_path, left_out):
    def ignored(folder, names):
        return [n for n in names if n in left_out or n in ("__pycache__", ".git")]

    shutil.copytree(REPO / "keyloom", tmp_path / "keyloom", ignore=ignored)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    names = said.stdout.split()
    assert "association_decomposition" in names and "pipeline" not in names
    assert any(n.startswith("op1_") for n in names) == ("llm" not in left_out and (REPO / "keyloom/llm").exists())
