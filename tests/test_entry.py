"""The entry module: with all parts, and where the training-data folders are gone."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_sql_belongs_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def _copy(tmp_path, *gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *gone))
    return copy


def _run(copy, *args):
    return subprocess.run([sys.executable, *args], cwd=copy, env={"PATH": os.environ.get("PATH", "/usr/bin:/bin"), "PYTHONPATH": str(copy), "HOME": str(copy)}, capture_output=True, text=True, timeout=600)


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_the_training_data_folders_the_rest_works(tmp_path, gone):
    copy = _copy(tmp_path, *gone)
    assert (copy / "corpus_pipeline.py").exists() == (len(gone) == 1)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    out = _run(copy, "-c", code)
    assert out.returncode == 0, out.stderr
    if len(gone) == 1:
        out = _run(copy, "-m", "pytest", "-q", "-x", "tests/test_names.py", "tests/test_whole_tables.py", "tests/test_operators.py", "tests/test_queries.py", "-k", "not test_query_gives or t01 or a01 or j01 or v01")
        assert out.returncode == 0, out.stdout[-3000:]


def test_what_else_is_missing_is_an_error(tmp_path):
    copy = _copy(tmp_path)
    broken = copy / "postloom" / "llm" / "warc.py"
    if not broken.exists():
        pytest.skip("the folders are gone")
    broken.write_text(broken.read_text() + "\nimport no_such_module_here\n")
    out = _run(copy, "-c", "import __spark_entry__")
    assert out.returncode and "no_such_module_here" in out.stderr


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "postloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "postloom.llm" not in p.read_text(), p
