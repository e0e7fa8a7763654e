"""The driver contract, with and without the training-data operators."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; print(' '.join(e.queries())); print(' '.join(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    return [set(line.split()) for line in out.stdout.splitlines()]


@pytest.mark.parametrize("leftover", [False, True])
def test_rest_stands_alone(tmp_path, leftover):
    shutil.copytree(ROOT / "quillmatch", tmp_path / "quillmatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if leftover:
        (tmp_path / "quillmatch" / "llm" / "__pycache__").mkdir(parents=True)
    queries, sql = names(tmp_path)
    assert "doc_fast_compare" in queries and not any(n.startswith("op1_") or n == "pipeline" for n in queries) and sql <= queries


def test_nothing_else_imports_the_operators():
    for path in (ROOT / "quillmatch").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the tables")
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
