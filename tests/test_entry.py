from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from checks import registry

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [[], ["corpus_pipeline.py"]])
def test_imports_without_the_operators_for_training_data(tmp_path, gone):
    left_out = shutil.ignore_patterns(
        "llm", ".git", "__pycache__", "spark-warehouse", ".pytest_cache", *gone
    )
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    assert not (copy / "countinghouse/llm").exists()
    found = subprocess.run(
        [sys.executable, "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120
    )
    assert found.returncode == 0, found.stderr
    names, stated = (line.split() for line in found.stdout.splitlines())
    assert names == sorted(registry.queries())
    assert set(stated) <= set(names)
