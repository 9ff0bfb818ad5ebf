"""Delimited text read as lines and parsed with column expressions.

The split, positional pick and typed conversion are native expressions
(``split``, ``get``, ``try_cast``), so a line that does not parse gives
NULL fields rather than a failed task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from farepath.functions.time import parse_timestamp


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per line, column ``value``."""
    return spark.read.text(path if isinstance(path, str) else list(path))


def drop_header(lines: DataFrame, header: str | None = None,
                column: str = "value") -> DataFrame:
    """Drop every line equal to the header. Each file of a multi-file input
    starts with the same header, so all copies go. When ``header`` is None
    the first line is fetched (one row to the driver)."""
    if header is None:
        first = lines.select(column).first()
        if first is None:
            return lines
        header = first[0]
    return lines.where(F.col(column) != F.lit(header))


def parse_delimited(lines: DataFrame, fields: Sequence[tuple[int, str, str]],
                    sep: str = ",", column: str = "value",
                    timestamp_format: str | None = "yyyy-MM-dd HH:mm:ss[.SSSSSS]") -> DataFrame:
    """Split each line on ``sep`` and keep ``fields`` as (position, name,
    type). Splitting is naive (no quoting), as for plain numeric layouts;
    use the CSV reader when fields can contain the separator.

    The fields are column expressions over ``value``. A filter on them is
    pushed below this projection with the expressions substituted, so a
    heavy filter re-evaluates the split; when the parsed rows feed such
    filters, read the file with :func:`read_delimited` instead."""
    parts = F.split(F.col(column), re.escape(sep), -1)
    out = []
    for pos, name, dtype in fields:
        raw = F.get(parts, pos)
        raw = F.when(raw == "", F.lit(None)).otherwise(raw)
        if dtype in ("timestamp", "timestamp_ntz"):
            out.append(parse_timestamp(raw, timestamp_format).alias(name))
        elif dtype == "string":
            out.append(raw.alias(name))
        else:
            out.append(raw.try_cast(dtype).alias(name))
    return lines.select(*out)


def read_delimited(spark: SparkSession, path: str | Sequence[str],
                   fields: Sequence[tuple[int, str, str]], sep: str = ",",
                   header: bool = True,
                   timestamp_format: str = "yyyy-MM-dd HH:mm:ss[.SSSSSS]") -> DataFrame:
    """Delimited text parsed once per line inside the scan: positions not
    in ``fields`` are read as unused strings, the kept ones get their type
    in the reader (malformed values become NULL), and the reader converts
    only the columns the query uses. ``header`` skips the first line of
    every file. Quotes are not special, as in a plain split."""
    by_pos = {pos: (name, dtype) for pos, name, dtype in fields}
    schema = StructType([
        StructField(by_pos[i][0], _parse_datatype_string(by_pos[i][1]), True) if i in by_pos
        else StructField(f"_unused_{i}", StringType(), True)
        for i in range(max(by_pos) + 1)
    ])
    df = (spark.read.schema(schema)
          .option("header", header)
          .option("enforceSchema", True)
          .option("sep", sep)
          .option("quote", "\u0000")
          .option("mode", "PERMISSIVE")
          .option("timestampNTZFormat", timestamp_format)
          .csv(path if isinstance(path, str) else list(path)))
    return df.select(*[name for _, name, _ in fields])
