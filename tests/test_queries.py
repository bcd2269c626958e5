"""Every registered graph query against its SQL in DuckDB, on the smallest tables."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from quadloom.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def norm(row):
    return tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, con, name):
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    rows = sorted(norm([r[want.columns.index(c)] for c in order]) for r in want.fetchall())
    assert sorted(norm(r) for r in got.select(*[f"`{c}`" for c in order]).collect()) == rows


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["c", "nation", "region", "orders"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("quadloom/llm", "tests/llm"), ("quadloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_llm_folders(tmp_path, gone):
    """In a copy without them the entry point has every other query and its SQL, and every other module imports."""
    repo, copy = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tmp_path / "copy"
    shutil.copytree(repo, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for part in gone:
        if (copy / part).is_dir():
            shutil.rmtree(copy / part)
        elif (copy / part).exists():
            (copy / part).unlink()
    code = """
import importlib, pkgutil, sys
import __spark_entry__ as entry, quadloom
from quadloom.queries import ORACLE, QUERIES
assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE) and len(QUERIES) > 80
for found in pkgutil.walk_packages(quadloom.__path__, "quadloom."):
    importlib.import_module(found.name)
assert not [m for m in sys.modules if m.startswith("quadloom.llm") or m == "corpus_pipeline"]
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(copy)})
