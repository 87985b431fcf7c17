"""Training-data queries with SQL counterparts, against DuckDB; and the registry."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from notes_engine.llm import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if pd.isna(value):
        return "NULL"
    if isinstance(value, (str, bool)) or type(value).__name__ in ("bool_", "bool"):
        return str(value)
    return f"{float(value):.9g}"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf_dir, duck, name):
    got, wanted = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    columns = sorted(got.columns)
    rows = lambda f: sorted(tuple(map(plain, r)) for r in f[columns].itertuples(index=False))
    assert rows(got) == rows(wanted)


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k[: k.index("_") + 1] for k in names if k.startswith("op")}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
