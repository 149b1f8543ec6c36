"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from pantrylake.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, (int, float, Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{float(v):.9g}")
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    theirs = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=str)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_run(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "p_type"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_corpus_operators():
    from pathlib import Path

    top = Path(registry.__file__).parent.parent
    for path in top.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
