"""Each query over the star schema and the events against its SQL, run by DuckDB over the same tables."""

from pathlib import Path

import duckdb
import pytest
from conftest import plain

import __spark_entry__

QUERIES = {name: q for m in __spark_entry__.MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in __spark_entry__.MODULES for name, sql in m.ORACLES.items()}
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = [tuple(r[c] for c in columns) for r in df.collect()]
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    theirs = [tuple(r[names.index(c)] for c in columns) for r in got.fetchall()]
    assert sorted(names) == columns
    assert plain(ours) == plain(theirs)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 25


def test_each_query_is_registered():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in __spark_entry__.MODULES)  # no name twice
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
