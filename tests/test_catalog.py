"""Registered queries against DuckDB on the same tables; and the entry module without the optional parts."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from notes_engine import catalog

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if value is None or (not isinstance(value, (list, dict)) and pd.isna(value)):
        return "NULL"
    if isinstance(value, float):
        return repr(round(value, 9)) if value != int(value) else str(int(value))
    return str(int(value)) if isinstance(value, (int,)) and not isinstance(value, bool) else str(value)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    out = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(out)
        return
    assert rows_of(out) == rows_of(duck.execute(catalog.ORACLE_SQL[name]).df())


def test_entry_imports_without_the_optional_parts(tmp_path):
    """A copy without the llm folder and the pipeline still has all other queries."""
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if "llm" not in rel.parts and rel.name != "corpus_pipeline.py" and rel.parts[0] != "tests":
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'note_fold' in q and 'pipeline' not in q and set(o) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) == len(catalog.QUERIES)
