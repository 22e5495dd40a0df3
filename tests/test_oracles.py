"""Every query with SQL agrees with DuckDB on the same tables."""

import os

import duckdb
import pytest

from voxelloom.oracles import ORACLES
from voxelloom.queries import QUERIES

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf, name)}.parquet'")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, duck, name):
    ours = QUERIES[name](spark, sf).toPandas()
    theirs = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
