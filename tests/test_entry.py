"""The entry module without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_loads_without_the_training_data_operators(tmp_path, left_out):
    shutil.copytree(ROOT / "signalpact", tmp_path / "signalpact", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in {"__spark_entry__.py", "corpus_pipeline.py"}.difference(left_out):
        shutil.copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(q) == set(o) and len(q) > 50 and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
