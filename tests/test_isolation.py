"""The library and its queries work without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def loads(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True, timeout=300)
    return out.stdout.split()


def test_entry_loads_without_the_llm_folders(tmp_path):
    copy = tmp_path / "repo"
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache")
    shutil.copytree(REPO, copy, ignore=skip)
    from checks.spark_queries import QUERIES

    assert loads(copy) == [str(len(QUERIES)), str(len(QUERIES)), "False"]


def test_nothing_else_imports_the_llm_folder():
    for file in (REPO / "weirflow").rglob("*.py"):
        if "llm" not in file.relative_to(REPO).parts:
            assert "weirflow.llm" not in file.read_text(), file
