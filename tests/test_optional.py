"""The library without its optional part: the registry still names and builds every other query."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from workload.queries import QUERIES

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = "import __spark_entry__ as e; assert e.__file__.startswith('{root}'); print(len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("without_pipeline", [False, True])
def test_registry_without_the_optional_folders(tmp_path, without_pipeline):
    for name in ("echoloom", "workload"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    files = ["__spark_entry__.py"] if without_pipeline or not (ROOT / "corpus_pipeline.py").exists() else ["__spark_entry__.py", "corpus_pipeline.py"]
    for name in files:
        shutil.copy(ROOT / name, tmp_path / name)
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=tmp_path)], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert run.stdout.split() == [str(len(QUERIES))] * 2
