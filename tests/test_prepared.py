"""What a query writes before it runs: only the files that it reads."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from farepath.plans.inspect import physical_plan
from farepath.registry import QUERIES
from farepath.schemas import TRIPS_2015, TRIPS_2024
from farepath.sources import read_csv, tables

TABLES = {
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double",
                 [(o, o * 7 % 40, o % 9, k, float(o % 50), 10.25 * o, 0.05, 0.02) for o in range(300) for k in (1, 2)] + [(1, None, 2, None, None, None, None, None), (None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double",
               [(o, o % 20, dt.datetime(1994, 3, 1 + o % 28), 100.5 + o) for o in range(300)] + [(7, 3, dt.datetime(1995, 1, 2), 1.0)]),
    "customer": ("c_custkey long, c_nationkey int", [(c, c % 4) for c in range(20)]),
    "supplier": ("s_suppkey long, s_nationkey int", [(s, s % 5) for s in range(9)]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(n, f"N{n}", n % 3) for n in range(5)]),
    "region": ("r_regionkey int, r_name string", [(0, "AFRICA"), (1, "AMERICA"), (2, "ASIA")]),
}


@pytest.fixture()
def sf(spark, out_dir):
    """A folder of tables that no query has read: duplicate and NULL keys too."""
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{out_dir}/{name}.parquet")
    return out_dir


def prepared(sf) -> set[str]:
    return {kind for _, folder, kind in tables._prepared if folder == sf}


def test_ingest_of_zones_writes_no_trips(spark, sf):
    rows = QUERIES["parquet_ingest_zones"](spark, sf).collect()
    assert sorted(map(tuple, rows))[:2] == [(0, "AFRICA", "N0", None), (1, "AMERICA", "N1", None)] and len(rows) == 5
    assert prepared(sf) == {"lookup-parquet", "lookup-csv"}


def test_ingest_of_all_files_still_has_all(spark, sf):
    assert {r["file"] for r in QUERIES["parquet_ingest_files"](spark, sf).collect()} == {"trips_2024", "trips_2015", "zones"}


def test_ingest_of_the_2015_file_writes_one_copy_of_the_trips(spark, sf):
    rows = QUERIES["parquet_ingest_2015"](spark, sf).collect()
    assert prepared(sf) == {"trips-csv-2015"}
    columns = [f.name for f in TRIPS_2015.fields]
    trips = tables.derive_trips(spark, sf).select(*columns).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, map(tuple, trips))) and len(rows) == 603


@pytest.mark.parametrize("first", [None, "parquet"])
def test_csv_trips_are_compressed_and_whole(spark, sf, first):
    if first:  # the Parquet copy is there already and is read
        tables.prepared_trips(spark, sf)
        assert "Join" not in physical_plan(tables._trips_once(spark, sf), "simple")
    path = tables.trips_csv_path(spark, sf, "2024")
    names = [n for n in os.listdir(path.removeprefix("file:")) if n.startswith("part-")]
    assert names and all(n.endswith(".csv.gz") for n in names)
    rows = read_csv(spark, path, TRIPS_2024).collect()
    trips = tables._in_layout(tables.derive_trips(spark, sf), TRIPS_2024).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, map(tuple, trips))) and len(rows) == 603


def test_same_region_on_csv_writes_one_copy_of_the_trips(spark, sf):
    rows = list(map(tuple, QUERIES["same_region_trip_counts_csv"](spark, sf).collect()))
    assert prepared(sf) == {"trips-csv-2024", "lookup-parquet", "lookup-csv"}
    assert rows == list(map(tuple, QUERIES["same_region_trip_counts"](spark, sf).collect())) and rows
