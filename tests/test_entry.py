"""The entry module with and without the training-data subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def _copy(to, *without):
    skipped = shutil.ignore_patterns(".git", "__pycache__", *without)
    shutil.copytree(REPO, to, ignore=skipped)
    return to


def _names(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    return set(subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, check=True, timeout=300).stdout.split())


def test_other_queries_stay_without_the_subpackage(tmp_path):
    whole = _names(REPO)
    without = _names(_copy(tmp_path / "all", "llm", "corpus_pipeline.py"))
    assert without == {n for n in whole if n != "pipeline" and not re.match(r"op\d", n)} and len(without) > 70
    # The pipeline's own file alone is not enough for its query, and no folder of compiled files is either.
    left = _copy(tmp_path / "pipeline", "llm")
    (left / "lodestar/llm/__pycache__").mkdir(parents=True)
    assert _names(left) == without
