"""Delimited input with a second channel for the rows that the parser refuses.

A permissive reader turns what doesn't parse into NULLs without a trace. Here
every row of the input is either accepted or refused as a whole: a refused row
keeps its file, its line as it stands and the reason. Both sides are columns
of one scan; nothing is collected.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from farepath.functions.time import parse_timestamp
from farepath.sources.files import CSV_TIMESTAMP_FORMAT

#: Column of a checked row that holds a refused line; the reader's own.
LINE = "_refused_line"
TOO_FEW, TOO_MANY, OTHER = "too few fields", "too many fields", "not readable"


def _typed(text: Column, kind: DataType, timestamp_format: str) -> Column:
    if isinstance(kind, (TimestampNTZType, TimestampType)):
        return parse_timestamp(text, timestamp_format)
    return text if isinstance(kind, StringType) else text.try_cast(kind)


def _first(reasons: Sequence[Column]) -> Column:
    return F.coalesce(*reasons, F.lit(OTHER))


def read_csv_checked(spark: SparkSession, path: str | Sequence[str], schema: StructType, header: bool = True,
                     timestamp_format: str = CSV_TIMESTAMP_FORMAT) -> DataFrame:
    """CSV rows by a fixed schema, with ``file`` and ``_refused_line`` (NULL in
    accepted rows). A row is refused if its number of fields isn't the
    schema's or a field that isn't empty doesn't fit its type."""
    reader = (spark.read.schema(StructType([*schema.fields, StructField(LINE, StringType())]))
              .option("header", header).option("enforceSchema", not header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE)
              .option("timestampNTZFormat", timestamp_format).option("timestampFormat", timestamp_format))
    rows = reader.csv(path if isinstance(path, str) else list(path))
    # The reader checks only the fields that a query uses; this always holds
    # and uses all of them.
    rows = rows.filter(F.hash(*[F.col(f"`{f.name}`") for f in schema.fields]) >= -2 ** 31)
    return rows.select("*", F.col("_metadata.file_path").alias("file"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col(LINE).isNull()).drop(LINE, "file")


def refused(checked: DataFrame, schema: StructType, timestamp_format: str = CSV_TIMESTAMP_FORMAT) -> DataFrame:
    """``file``, ``line`` and ``reason`` of the refused rows: the first that
    holds of too few fields, too many, and the first field that doesn't fit."""
    names = [f"_{i}" for i in range(len(schema.fields))]
    # The line once more, as text: fields by place, one further for what is too much.
    fields = F.from_csv(F.col(LINE), ", ".join(f"{n} string" for n in [*names, "_more"]))
    rows = (checked.filter(F.col(LINE).isNotNull())
            .select("file", F.col(LINE).alias("line"), fields.alias("f"), F.size(F.split(LINE, ",")).alias("n")))
    # A quoted separator only adds to the pieces of a plain split.
    few = F.when((F.col("n") < len(names)), F.lit(TOO_FEW))
    many = F.when(F.col("f._more").isNotNull(), F.lit(TOO_MANY))
    wrong = [F.when(_typed(F.col(f"f.{n}"), field.dataType, timestamp_format).isNull() & (F.col(f"f.{n}") != ""),
                    F.lit(f"{field.name} is not {field.dataType.simpleString()}")) for n, field in zip(names, schema.fields)]
    return rows.select("file", "line", _first([few, many, *wrong]).alias("reason"))


def parse_delimited_checked(lines: DataFrame, fields: Sequence[tuple[int, str, str]], sep: str = ",", column: str = "value",
                            timestamp_format: str = CSV_TIMESTAMP_FORMAT) -> DataFrame:
    """Lines split on ``sep`` without quoting, ``fields`` as (position, name,
    type), with ``_refused_line`` and ``reason`` (both NULL in accepted rows):
    the reader's rule for lines that are in a DataFrame already."""
    parts = F.split(F.col(column), re.escape(sep), -1)
    kinds = StructType.fromDDL(", ".join(f"`{name}` {kind}" for _, name, kind in fields))
    raw = [F.get(F.col("_parts"), place) for place, _, _ in fields]
    values = [_typed(F.when(r != "", r), f.dataType, timestamp_format) for r, f in zip(raw, kinds.fields)]
    least = max(place for place, _, _ in fields) + 1
    reasons = [F.when(F.size("_parts") < least, F.lit(TOO_FEW)),
               *[F.when(v.isNull() & (r != ""), F.lit(f"{f.name} is not {f.dataType.simpleString()}")) for r, v, f in zip(raw, values, kinds.fields)]]
    out = lines.select(F.col(column), parts.alias("_parts"))
    reason = F.coalesce(*reasons)
    return out.select(*[v.alias(f.name) for v, f in zip(values, kinds.fields)], F.when(reason.isNotNull(), F.col(column)).alias(LINE), reason.alias("reason"))


def counts_by_reason(checked: DataFrame, refusals: DataFrame) -> DataFrame:
    """``reason`` and ``rows``; the accepted ones under "accepted"."""
    taken = checked.filter(F.col(LINE).isNull()).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("accepted").alias("reason"), "rows")
    return taken.unionByName(refusals.groupBy("reason").agg(F.count(F.lit(1)).alias("rows")))

