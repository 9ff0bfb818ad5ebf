"""Layouts that later reads can skip: folders per period, rows sorted by time,
and tables bucketed by a join key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farepath.session import file_system

UNITS = ("year", "month", "week", "day")


def write_by_period(df: DataFrame, path: str, time_column: str, unit: str = "day", period_column: str = "period") -> str:
    """Parquet in one folder per period (its first day) of ``time_column``,
    each file's rows sorted by time, so that its row groups hold short ranges.

    Rows are dealt by ranges of time: a period with many rows is spread over
    several tasks, and a task writes to few folders. Only the periods that
    ``df`` holds are replaced; other folders stay as they are. Rows without a
    time have a folder of their own.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}; expected one of {UNITS}")
    period = F.date_trunc(unit, F.col(time_column)).cast("date").alias(period_column)
    writer = df.select("*", period).repartitionByRange(period_column, time_column).sortWithinPartitions(period_column, time_column).write.partitionBy(period_column)
    found = file_system(df.sparkSession, path)
    if found is not None and not found[0].exists(found[1]):
        writer.parquet(path)  # a first write; the next ones replace single folders
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return path


def read_between(spark: SparkSession, path: str, time_column: str, first: str, last: str, unit: str = "day", period_column: str = "period") -> DataFrame:
    """Rows of :func:`write_by_period` with ``first`` <= time < ``last``. Other
    periods' folders aren't listed; within the rest, row groups are skipped."""
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (first, last))
    period = F.col(period_column)
    return (spark.read.parquet(path)
            .filter((period >= F.date_trunc(unit, low).cast("date")) & (period < F.date_add(high.cast("date"), 1)))
            .filter((F.col(time_column) >= low) & (F.col(time_column) < high)).drop(period_column))


def write_bucketed(df: DataFrame, path: str, table: str, key: str, buckets: int) -> str:
    """A table whose files are bucketed and sorted by ``key``: a later join or
    aggregate on it needs no shuffle of this side. Its rows are first dealt by
    the key, so a small bucket is one file; one that is larger than a task's
    share (``spark.sql.adaptive.advisoryPartitionSizeInBytes``) is cut into
    files that several tasks write. The table is known to the session's catalog
    under its name. A key with a large share of all rows still makes a large
    bucket for the join; join such tables with
    :func:`farepath.operators.salted_lookup_join`."""
    dealt = df.hint("rebalance", key)
    (dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table))
    return table
