"""The entry without the training-text subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(k.startswith('op1') for k in e.queries()))"


@pytest.mark.parametrize("gone", [("tessera/llm", "tests/llm"), ("tessera/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_imports_without(tmp_path, gone):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", ".tmp", *[Path(g).name for g in gone]))
    said = subprocess.run([sys.executable, "-c", CODE], cwd=tree, env={"PYTHONPATH": str(tree), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.split()
    whole = "tessera/llm" not in gone and (ROOT / "tessera/llm").exists()
    assert int(said[0]) > 250 and int(said[1]) > 200
    assert said[2:] == ["False", str(whole)]
