from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from farepath.schemas import TRIPS_2015, ZONE_LOOKUP
from farepath.sinks import ingest_csv_to_parquet, write_csv, write_parquet, write_text
from farepath.sinks.files import IngestItem
from farepath.sources import (
    drop_header,
    parse_delimited,
    read_csv,
    read_csv_inferred,
    read_delimited,
    read_lines,
    read_parquet,
)

FIELDS = [(0, "VendorID", "int"), (1, "pickup", "timestamp_ntz"), (5, "lon", "double"), (6, "lat", "double")]


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def _write_lines(path, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_text_parse_empty_and_bad_fields_are_null(spark, out_dir):
    d = _local(out_dir)
    header = ",".join(f.name for f in TRIPS_2015.fields)
    _write_lines(d, [header,
                     "1,2015-01-15 19:05:39,2015-01-15 19:23:42,1,1.59,-73.99,40.75,1,N,-73.97,40.75",
                     "2,2015-01-15 19:05:39,,1,1.59,,40.75,1,N,-73.97,40.75",
                     "x,not-a-time,,1,1.59,abc,40.75"])
    lines = drop_header(read_lines(spark, out_dir))
    a = sorted((tuple(r) for r in parse_delimited(lines, FIELDS).collect()), key=str)
    b = sorted((tuple(r) for r in read_delimited(spark, out_dir, FIELDS).collect()), key=str)
    assert a == b
    assert len(a) == 3
    bad = [r for r in a if r[0] is None][0]
    assert bad == (None, None, None, 40.75)
    empty = [r for r in a if r[0] == 2][0]
    assert empty[2] is None and empty[1] == dt.datetime(2015, 1, 15, 19, 5, 39)


def test_drop_header_multi_file(spark, out_dir):
    d = _local(out_dir)
    _write_lines(d + "/a", ["h1,h2", "1,2"])
    _write_lines(d + "/b", ["h1,h2", "3,4"])
    lines = drop_header(read_lines(spark, [out_dir + "/a", out_dir + "/b"]), header="h1,h2")
    assert sorted(r.value for r in lines.collect()) == ["1,2", "3,4"]


def test_csv_round_trip_keeps_microseconds(spark, out_dir):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0, 7, 179575), "a,\"b\"")],
                               "id long, ts timestamp_ntz, s string")
    write_csv(df, out_dir)
    back = read_csv(spark, out_dir, df.schema)
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]


def test_csv_header_mismatch_fails_when_checked(spark, out_dir):
    df = spark.createDataFrame([(1, "Manhattan", "Midtown", "Yellow")],
                               "id int, Borough string, Zone string, service_zone string")
    write_csv(df, out_dir)
    with pytest.raises(Exception):
        read_csv(spark, out_dir, ZONE_LOOKUP).collect()
    assert read_csv(spark, out_dir, ZONE_LOOKUP, check_header=False).count() == 1


def test_ingest_default_mode_fails_then_overwrite(spark, out_dir):
    src = out_dir + "/src"
    df = spark.createDataFrame([(1, "Manhattan", "Midtown", "Yellow")], ZONE_LOOKUP)
    write_csv(df, src)
    items = [IngestItem(src, out_dir + "/fixed", ZONE_LOOKUP), IngestItem(src, out_dir + "/inferred")]
    ingest_csv_to_parquet(spark, items)
    with pytest.raises(AnalysisException):
        ingest_csv_to_parquet(spark, items)
    ingest_csv_to_parquet(spark, items, mode="overwrite")
    assert read_parquet(spark, out_dir + "/fixed").schema == ZONE_LOOKUP
    inferred = read_csv_inferred(spark, src)
    assert dict(inferred.dtypes)["LocationID"] == "int"


def test_parquet_and_text_sinks(spark, out_dir):
    df = spark.createDataFrame([("b",), ("a",)], "value string").orderBy("value")
    write_text(df, out_dir + "/t", single_file=True)
    files = [f for f in os.listdir(_local(out_dir + "/t")) if f.startswith("part-")]
    assert len(files) == 1
    with open(os.path.join(_local(out_dir + "/t"), files[0])) as fh:
        assert fh.read().split() == ["a", "b"]
    with pytest.raises(ValueError):
        write_text(df.select("value", F.lit(1)), out_dir + "/bad")
    write_parquet(df.withColumn("n", F.lit(1)), out_dir + "/p", partition_by=["value"])
    part = read_parquet(spark, out_dir + "/p").where("value = 'a'")
    assert part.count() == 1
    assert "PartitionFilters: [isnotnull(value" in __import__("farepath").plans.physical_plan(part, "simple")
