"""The library without the training-data operators: their folder, and with or without the
pipeline module, deleted from a copy."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("gone", [("quadrille/llm",), ("quadrille/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)], ids=["folder", "both", "module"])
def test_the_rest_works_without(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "spark-warehouse"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        elif (copy / name).exists():
            (copy / name).unlink()
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'bgp_star' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q); print(len(q))"], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
