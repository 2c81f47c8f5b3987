"""Every registered query with SQL gives the rows of that SQL."""

import glob
import os

import duckdb
import pytest

from clearlines.queries import all_oracles, all_queries


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query(spark, folder, duck, name):
    df = all_queries()[name](spark, folder)
    columns = sorted(df.columns)
    result = duck.execute(all_oracles()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())
    assert sorted(repr(tuple(row[c] for c in columns)) for row in df.collect()) == wanted


def test_oracles_belong_to_queries():
    assert set(all_oracles()) <= set(all_queries())
