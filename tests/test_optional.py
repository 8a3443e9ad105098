"""The package without its optional corpus part."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_without_corpus_operators(tmp_path):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "tests")
    shutil.copytree(HERE, copy, ignore=skip)
    assert (copy / "marketloom").is_dir() and not (copy / "marketloom" / "llm").exists()
    code = ("import __spark_entry__ as e; n = e.queries(); "
            "assert 'walk_forward_folds' in n and 'pipeline' not in n and not any(k.startswith('op1') for k in n); print(len(n))")
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120,
                          env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 50
