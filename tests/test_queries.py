"""Every registered query with SQL gives the rows that DuckDB gives; all queries run."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cairn.plans import catalogue, corpus, inventory, offices, planted, rates, search, state  # noqa: F401  they register
from cairn.plans.registry import ORACLE_SQL, QUERIES


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(shown(tuple(r[c] for c in columns)) for r in df.collect())
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert rows == sorted(shown(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
