"""Rows that the parser refuses, from the CSV reader and from lines."""

from __future__ import annotations

import os

import pytest
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType, TimestampNTZType

from farepath.sources import read_lines
from farepath.sources.refused import LINE, accepted, counts_by_reason, parse_delimited_checked, read_csv_checked, refused

SCHEMA = StructType().add("id", IntegerType()).add("at", TimestampNTZType()).add("name", StringType()).add("amount", DoubleType())
LINES = {
    "1,2024-01-01 00:00:00,plain,1.5": None,
    "2,,,": None,
    '3,2024-01-01 00:00:01.5,"a, b",2': None,
    "x,2024-01-01 00:00:00,word,1": "id is not int",
    "4,yesterday,word,1": "at is not timestamp_ntz",
    "5,2024-01-01 00:00:00,word,n/a": "amount is not double",
    "y,never,word,none": "id is not int",  # the first that doesn't fit
    "6,2024-01-01 00:00:00": "too few fields",
    "7,2024-01-01 00:00:00,word,1,more": "too many fields",
    "99999999999,2024-01-01 00:00:00,word,1": "id is not int",
}


@pytest.fixture()
def folder(out_dir):
    where = out_dir.removeprefix("file:")
    os.makedirs(where)
    for k, some in enumerate((list(LINES)[:5], list(LINES)[5:])):
        with open(f"{where}/part-{k}.csv", "w") as f:
            f.write("\n".join(["id,at,name,amount", *some]) + "\n")
    return out_dir


def test_every_row_is_accepted_or_refused_with_a_reason(spark, folder):
    checked = read_csv_checked(spark, folder, SCHEMA)
    rows = accepted(checked)
    assert rows.schema == SCHEMA
    assert sorted((r["id"], r["name"], r["amount"]) for r in rows.collect()) == [(1, "plain", 1.5), (2, None, None), (3, "a, b", 2.0)]
    found = refused(checked, SCHEMA).collect()
    assert {r["line"]: r["reason"] for r in found} == {line: reason for line, reason in LINES.items() if reason}
    assert {r["file"].rpartition("/")[2] for r in found} == {"part-0.csv", "part-1.csv"}


def test_counts_need_no_other_column(spark, folder):
    checked = read_csv_checked(spark, folder, SCHEMA)
    got = {r["reason"]: r["rows"] for r in counts_by_reason(checked, refused(checked, SCHEMA)).collect()}
    assert got == {"accepted": 3, "id is not int": 3, "at is not timestamp_ntz": 1, "amount is not double": 1, "too few fields": 1, "too many fields": 1}
    assert accepted(checked).select("id").count() == 3  # fewer columns refuse the same rows


def test_a_header_of_other_names_fails(spark, folder):
    with pytest.raises(Exception):
        accepted(read_csv_checked(spark, folder, StructType().add("a", IntegerType()).add("b", StringType()).add("c", StringType()).add("d", DoubleType()))).collect()


def test_lines_in_a_frame(spark):
    lines = spark.createDataFrame([(line,) for line in LINES if '"' not in line], "value string")
    got = parse_delimited_checked(lines, [(0, "id", "int"), (1, "at", "timestamp_ntz"), (3, "amount", "double")]).collect()
    want = {line: reason for line, reason in LINES.items() if '"' not in line}
    want["7,2024-01-01 00:00:00,word,1,more"] = None  # further fields aren't looked at
    assert {r[LINE]: r["reason"] for r in got if r["reason"]} == {line: reason for line, reason in want.items() if reason}
    assert sorted(r["id"] for r in got if r["reason"] is None) == [1, 2, 7]


def test_nothing_to_read(spark, out_dir):
    spark.createDataFrame([], SCHEMA).write.option("header", True).csv(out_dir)
    checked = read_csv_checked(spark, out_dir, SCHEMA)
    assert accepted(checked).collect() == [] and refused(checked, SCHEMA).collect() == []
    assert parse_delimited_checked(read_lines(spark, out_dir), [(0, "id", "int")]).count() <= 1
