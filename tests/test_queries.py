"""Each query against its SQL in DuckDB, and the entry points."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 7)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_its_sql(spark, con, name):
    df = catalog.queries()[name](spark, SMALL)
    cur = con.execute(catalog.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted((repr(plain(tuple(r))) for r in df.select(*cols).collect())) == sorted(repr(plain(r)) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_sql_it_runs(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_optional_folder(tmp_path):
    for p in ("__spark_entry__.py", "sparkloom"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "sparkloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'token_count' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_optional_folder():
    for p in (ROOT / "sparkloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "sparkloom.llm" not in p.read_text(), p
