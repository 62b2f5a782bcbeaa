"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from dossier.plans import registry

DATA = "/root/testdata/sf0.001"


def _plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return str(value) if not isinstance(value, (int, bool)) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    found = registry.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    ours = sorted((tuple(_plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    cursor = con.execute(registry.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert ours == theirs


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert callable(entry.entry)
