"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from corpuspack.plans import catalogue

SF = Path("/root/testdata/sf0.001")


def compare(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)

    def key(row):
        return [f"{v:.6f}" if isinstance(v, float) and not math.isnan(v) else str(v.tolist() if hasattr(v, "tolist") else v) for v in row]

    assert sorted(map(key, got[names].itertuples(index=False, name=None))) == sorted(map(key, want[names].itertuples(index=False, name=None)))


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, str(SF)).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        compare(got, duck.execute(sql).fetchdf())


def test_entry_imports_without_the_training_data_part(tmp_path):
    """In a copy that lacks the two folders and the pipeline."""
    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "corpuspack", tmp_path / "corpuspack", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(catalogue.queries())), str(len(catalogue.oracle_sql())), "False"]


def test_what_the_package_offers():
    import corpuspack

    assert all(callable(getattr(corpuspack, name)) for name in corpuspack.__all__ if name != "__version__")
    with pytest.raises(AttributeError):
        corpuspack.nothing_like_it
