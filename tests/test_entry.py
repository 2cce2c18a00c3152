import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

HERE = Path(__file__).resolve().parent.parent


def test_registered(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(isinstance(x, str) for x in sql.values()) and all(map(callable, queries.values()))
    assert entry.entry(spark).columns == ["matches"]


def test_without_the_subpackage(tmp_path):
    """With the operators for training data deleted, even where caches stay behind, the other queries are there."""
    for name in ("quarry", "__spark_entry__.py"):
        (shutil.copytree if (HERE / name).is_dir() else shutil.copy)(HERE / name, tmp_path / name)
    shutil.rmtree(tmp_path / "quarry/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), set(e.queries()) == set(e.oracle_sql()) == set(e.registry.QUERIES))"
    run = lambda: subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, capture_output=True, text=True)
    assert run().stdout.split() == [str(len(entry.registry.QUERIES)), "True"]
    (tmp_path / "quarry/llm/__pycache__").mkdir(parents=True)
    assert run().stdout.split() == [str(len(entry.registry.QUERIES)), "True"]


def test_other_import_errors_are_raised(monkeypatch):
    def missing(name):
        raise ModuleNotFoundError("no regex", name="regex")

    monkeypatch.setattr(importlib, "import_module", missing)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
