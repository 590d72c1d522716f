"""The registries agree, and the oracles match on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def test_registries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


CORE = sorted(set(entry.oracle_sql()) - {n for n in entry.oracle_sql() if n[0] == "p" and n[1].isdigit()})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables aren't here")
@pytest.mark.parametrize("name", CORE)
def test_oracle(spark, duck, name):
    want = duck.execute(entry.oracle_sql()[name]).fetchall()
    names = [d[0] for d in duck.description]
    df = entry.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, df.select(*(f"`{n}`" for n in names)).collect()))) == sorted(map(repr, want))
