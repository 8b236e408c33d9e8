"""Every registered query that has SQL against DuckDB, on whole tables of the smallest size."""

from __future__ import annotations

import os
from datetime import datetime

import duckdb
import pytest

from tracewright.plans import workload

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: v.isoformat() if isinstance(v, datetime) else v
    return sorted(repr([value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_query_equals_sql(spark, con, name):
    got = workload.QUERIES[name](spark, SF)
    want = con.execute(workload.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canon(got.columns, [tuple(r) for r in got.collect()]) == canon(columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
