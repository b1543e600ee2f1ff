"""Every registered query against its SQL in DuckDB, as the driver compares them."""

import math
import os

import duckdb
import pytest

from tessera.plans import catalog
from tessera.sources.tables import CORPUS, RELATIONAL

FOLDER = os.environ.get("TESSERA_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in RELATIONAL + CORPUS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_duckdb(spark, duck, name):
    out = catalog.QUERIES[name](spark, FOLDER)
    got = out.collect()
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(out.columns) == sorted(names)
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted((tuple(plain(row[i]) for i in order) for row in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[names[i]]) for i in order) for r in got), key=str) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
