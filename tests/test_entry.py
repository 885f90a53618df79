"""The entry module with the corpus subpackage and without it."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
NAMES = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert o.keys() <= q.keys(); print(*q)"


def names(folder):
    return subprocess.run([sys.executable, "-c", NAMES], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def without_corpus(folder, *more):
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *more))
    return names(folder)


def test_imports_without_the_corpus_subpackage(tmp_path):
    kept, bare = without_corpus(tmp_path / "a"), without_corpus(tmp_path / "b", "corpus_pipeline.py")
    assert kept == bare and "candles_60m" in kept and "pipeline" not in kept
    assert not any(n.startswith("op") and n[2:3].isdigit() for n in kept)


def test_nothing_else_imports_the_corpus_subpackage():
    for path in (ROOT / "tidewick").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert ".llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
