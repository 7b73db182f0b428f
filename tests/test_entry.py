"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from weftline.queries import registry


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["domain", "value", "low", "high", "share", "place"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def run_in(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=300)


NAMES = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q, set(e.oracle_sql()) == set(q))"


def test_the_rest_works_without_the_subpackage(tmp_path):
    """A copy of the repository without its folders and without the pipeline."""
    root = Path(entry.__file__).parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    done = run_in(tmp_path / "copy", NAMES)
    assert done.returncode == 0, done.stderr
    count, *rest = done.stdout.split()
    assert int(count) == len(registry.QUERIES) and rest == ["False", "False", "True"]


def test_a_missing_library_leaves_the_rest(tmp_path):
    """A library that only the subpackage uses cannot be imported: the other queries stay."""
    done = run_in(Path(entry.__file__).parent, "import sys; sys.modules['ahocorasick'] = None\n" + NAMES)
    assert done.returncode == 0 and "left out" in done.stderr and done.stdout.split()[1:] == ["False", "False", "True"]


def test_nothing_else_imports_the_subpackage():
    root = Path(entry.__file__).parent
    users = [p for p in root.glob("weftline/**/*.py") if "llm" not in p.parts and "weftline.llm" in p.read_text()]
    assert users == []
