"""The library and its queries stand without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _copied(tmp_path, *left_out):
    there = tmp_path / "copy"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *left_out))
    return there


@pytest.mark.parametrize("left_out", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_stands_without_training_data_operators(tmp_path, left_out):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'ttm_rolling' in q and set(o) <= set(q); assert not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=_copied(tmp_path, *left_out), env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_a_missing_library_is_no_missing_subpackage(tmp_path):
    """Without zstandard the training-data queries must fail aloud, not vanish."""
    there = _copied(tmp_path)
    (there / "zstandard.py").write_text("raise ModuleNotFoundError(\"No module named 'zstandard'\", name='zstandard')\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=there, env=env, capture_output=True, text=True)
    assert done.returncode != 0 and "zstandard" in done.stderr


def test_nothing_else_imports_them():
    for folder, _, files in os.walk(os.path.join(ROOT, "tidemark")):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "tidemark.llm" not in f.read(), name
