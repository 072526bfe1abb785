"""Every catalogue query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans.catalogue import QUERIES
from tessera.plans.oracles import ORACLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(rows, columns):
    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}"
        return v

    return sorted([tuple((c, value(r[c])) for c in sorted(columns)) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows(spark, con, name):
    out = QUERIES[name](spark, DATA)
    relation = con.sql(ORACLES[name])
    assert sorted(out.columns) == sorted(relation.columns)
    want = [dict(zip(relation.columns, r)) for r in relation.fetchall()]
    assert plain([r.asDict() for r in out.collect()], out.columns) == plain(want, out.columns)


def test_every_query_is_registered(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
