"""The registered corpus queries that SQL can express, against DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from farepath.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(want.columns)
    rows = lambda many, columns: sorted(
        tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for _, v in sorted(zip(columns, r))) for r in many)
    assert rows(map(tuple, found.collect()), found.columns) == rows(want.fetchall(), want.columns)
