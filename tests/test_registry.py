"""Every registered query against its DuckDB oracle on the driver's tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from farepath.registry import ORACLE_SQL, QUERIES
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return repr(v)


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLE_SQL[name])
    exp = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert _bag(df.columns, got) == _bag(rel.columns, exp)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["Pickup Zone", "Dropoff Zone", "TotalTrips"]
    assert df.count() > 0


def test_prepared_table_rebuilt_when_missing(spark):
    from farepath.sources import tables

    path = tables.prepared_lookup_path(spark, SF_SMALL)
    key = (tables.session_key(spark), SF_SMALL, "lookup-parquet")
    assert tables._prepared[key][0] == path
    tables._prepared[key] = (path + "-missing", tables._prepared[key][1])  # as if the folder had been removed
    again = tables.prepared_lookup_path(spark, SF_SMALL)
    assert again not in (path, path + "-missing")
    assert tables.prepared_lookup(spark, SF_SMALL).count() == 25


def test_prepared_table_rebuilt_when_its_source_changes_or_the_write_did_not_end(spark, tmp_path):
    import os
    import shutil

    from farepath.sources import tables

    sf = str(tmp_path / "sf")
    os.makedirs(sf)
    for name in ("nation", "region"):
        shutil.copy(f"{SF_SMALL}/{name}.parquet", sf)
    first = tables.prepared_lookup_path(spark, sf)
    assert tables.prepared_lookup_path(spark, sf) == first
    spark.read.parquet(f"{SF_SMALL}/nation.parquet").limit(3).write.mode("overwrite").parquet(f"{sf}/nation.parquet")
    second = tables.prepared_lookup_path(spark, sf)
    assert second != first and tables.prepared_lookup(spark, sf).count() == 3
    os.remove(f"{second.removeprefix('file:')}/_SUCCESS")
    assert tables.prepared_lookup_path(spark, sf) != second


def test_derived_trips_meet_every_branch(spark):
    from farepath.registry import _trips

    hours = {r.HourofDay for r in QUERIES["pickup_hour_means"](spark, SF_SMALL).collect()}
    assert hours == set(range(24))
    trips = _trips(spark, SF_SMALL)
    night = sum(r.NightTrips for r in QUERIES["night_trip_counts"](spark, SF_SMALL).collect())
    assert 0 < night < trips.count()
    assert len(QUERIES["region_revenue"](spark, SF_SMALL).columns) == 1 + 8
    assert len(QUERIES["csv_scan_schema"](spark, SF_SMALL).columns) == 20
    assert len(QUERIES["csv_scan_inferred"](spark, SF_SMALL).columns) == 19
    minutes = [r.duration_min for r in QUERIES["trip_duration_minutes"](spark, SF_SMALL).collect()]
    known = [m for m in minutes if m is not None]
    assert len(known) < len(minutes) and min(known) < 0 and any(m != round(m) for m in known)


def test_runs_leave_no_further_copies(spark):
    from farepath.session import file_system, named_scratch_path

    for name in ("parquet_ingest", "text_report"):
        for _ in range(2):
            QUERIES[name](spark, SF_SMALL).count()
    for name, within in (("ingest/trips_2024", 1), ("report", 1)):
        fs, path = file_system(spark, named_scratch_path(spark, name))
        assert len([s for s in fs.listStatus(path) if s.getPath().getName() == "_SUCCESS"]) == within
