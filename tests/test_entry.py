"""The driver contract with and without the llm subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_survives_without_llm(tmp_path):
    for name in ("orrery", "__spark_entry__.py"):
        source = REPO / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)


def test_nothing_else_names_the_subpackage():
    for path in (REPO / "orrery").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "orrery.llm" not in path.read_text()
