"""File scans. Column lists passed here reach the Parquet reader as its
ReadSchema; filters applied afterwards are pushed down by Catalyst."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from farepath.records import read_record, source_signature, write_record

# Fixed value: timestamp layout for CSV written and read by this library;
# microseconds are kept (the default layout drops them).
CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def read_parquet(spark: SparkSession, path: str | Sequence[str],
                 columns: Sequence[str] | None = None) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType,
             columns: Sequence[str] | None = None, header: bool = True,
             check_header: bool = True, mode: str = "PERMISSIVE",
             timestamp_format: str = CSV_TIMESTAMP_FORMAT) -> DataFrame:
    """CSV with a fixed schema: no inference pass over the data.

    ``check_header`` compares the file header with the schema's names
    (``enforceSchema=false``), so a file with other columns fails instead of
    binding by position. Malformed fields become NULL in PERMISSIVE mode.
    """
    reader = (
        spark.read.schema(schema)
        .option("header", header)
        .option("enforceSchema", not (header and check_header))
        .option("mode", mode)
        .option("timestampNTZFormat", timestamp_format)
        .option("timestampFormat", timestamp_format)
    )
    df = reader.csv(path if isinstance(path, str) else list(path))
    return df.select(*columns) if columns else df


def read_csv_inferred(spark: SparkSession, path: str | Sequence[str],
                      columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with header names and types inferred from all of the data, an
    extra pass; prefer :func:`read_csv` on big input."""
    df = (
        spark.read.option("header", True)
        .option("inferSchema", True)
        .option("timestampFormat", CSV_TIMESTAMP_FORMAT)
        .csv(path if isinstance(path, str) else list(path))
    )
    return df.select(*columns) if columns else df


def read_csv_inferred_once(spark: SparkSession, path: str, records: str, columns: Sequence[str] | None = None) -> DataFrame:
    """:func:`read_csv_inferred` whose schema is kept in a record in the folder
    ``records``, under the signature of the files at ``path``. While the files
    are the same, a later read (of any session) starts no job for the schema."""
    signature = source_signature(spark, path)
    known = read_record(spark, records, path)
    if known and known["signature"] == signature:
        schema = StructType.fromJson(known["schema"])
    else:
        schema = read_csv_inferred(spark, path).schema
        write_record(spark, records, path, {"signature": signature, "schema": json.loads(schema.json())})
    return read_csv(spark, path, schema, columns)
