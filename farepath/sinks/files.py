"""File sinks. Write mode is always explicit, and ``overwrite`` replaces the
old output only once the new one is whole; ``single_file`` merges the
partitions of an already small (aggregated) result into one file, keeping
a global sort order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from farepath.sinks.commit import replace_folder
from farepath.sources.files import CSV_TIMESTAMP_FORMAT, read_csv, read_csv_inferred


def _prepare(df: DataFrame, single_file: bool) -> DataFrame:
    return df.coalesce(1) if single_file else df


def _put(df: DataFrame, path: str, mode: str, single_file: bool, write) -> str:
    """Overwriting goes through a folder beside (see :mod:`.commit`); the other
    modes write in place. ``write`` gets a writer and a path."""
    ready = _prepare(df, single_file)
    if mode == "overwrite":
        return replace_folder(df.sparkSession, path, lambda place, how: write(ready.write.mode(how), place))
    write(ready.write.mode(mode), path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists",
              header: bool = True, single_file: bool = False, compression: str = "none") -> str:
    return _put(df, path, mode, single_file, lambda writer, place: (
        writer.option("header", header)
        .option("compression", compression)
        .option("timestampNTZFormat", CSV_TIMESTAMP_FORMAT)
        .option("timestampFormat", CSV_TIMESTAMP_FORMAT)
        .csv(place)))


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_by: Sequence[str] | None = None,
                  single_file: bool = False) -> str:
    return _put(df, path, mode, single_file, lambda writer, place:
                (writer.partitionBy(*partition_by) if partition_by else writer).parquet(place))


def write_text(df: DataFrame, path: str, mode: str = "errorifexists",
               single_file: bool = False) -> str:
    """``df`` must have exactly one string column."""
    if len(df.columns) != 1:
        raise ValueError(f"text sink needs one string column, got {df.columns}")
    return _put(df, path, mode, single_file, lambda writer, place: writer.text(place))


@dataclass(frozen=True)
class IngestItem:
    source: str
    target: str
    schema: StructType | None = None  # None: header names, inferred types


def ingest_csv_to_parquet(spark: SparkSession, items: Sequence[IngestItem],
                          mode: str = "errorifexists") -> list[str]:
    """Convert CSV files to Parquet, one schema rule per file. Each file is
    one distributed read and write; nothing passes through the driver."""
    written = []
    for item in items:
        df = (read_csv(spark, item.source, item.schema) if item.schema is not None
              else read_csv_inferred(spark, item.source))
        written.append(write_parquet(df, item.target, mode=mode))
    return written
