"""Without this subpackage and the pipeline the rest must import and answer."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_rest_imports_without_llm(tmp_path):
    shutil.copytree(ROOT / "weft", tmp_path / "weft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'hybrid_rrf' in q and set(s) <= set(q) and not any(k.startswith('op') for k in q); print(len(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_other_missing_modules_are_errors(tmp_path):
    shutil.copytree(ROOT / "weft", tmp_path / "weft", ignore=shutil.ignore_patterns("common.py", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode != 0 and "weft.llm.common" in run.stderr


def test_nothing_else_imports_llm():
    for f in (ROOT / "weft").rglob("*.py"):
        if "llm" not in f.parts:
            assert "weft.llm" not in f.read_text() and "import llm" not in f.read_text(), f
