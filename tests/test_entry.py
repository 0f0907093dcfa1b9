"""The entry module with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
NAMES = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q, any(k.startswith('op1_') for k in q))"


def names_in(folder: Path) -> list[str]:
    return subprocess.run([sys.executable, "-c", NAMES], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split()


def test_imports_with_and_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "whole", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    shutil.copytree(ROOT, tmp_path / "rest", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    shutil.copytree(ROOT, tmp_path / "half", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    rest = names_in(tmp_path / "rest")
    assert rest[1:] == ["False", "False"] and names_in(tmp_path / "half") == rest
    if (ROOT / "tickloom" / "llm").exists():
        assert names_in(tmp_path / "whole")[1:] == ["True", "True"]
