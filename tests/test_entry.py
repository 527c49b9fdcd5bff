"""The entry works with and without the operators over training text."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["tallyspark/llm", "tests/llm"], ["tallyspark/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_registers_without(tmp_path, gone):
    home = tmp_path / "repo"
    shutil.copytree(REPO, home, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    for name in gone:
        path = home / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print('consumer_joy' in q, 'pipeline' in q, any(x.startswith('op1_') for x in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=home, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)
    assert out.returncode == 0, out.stderr
    left = (home / "tallyspark" / "llm").exists()
    assert out.stdout.split() == ["True", str(left and (home / "corpus_pipeline.py").exists()), str(left)]
