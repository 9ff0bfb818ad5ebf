"""Header plus one text line per result row, in a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farepath.functions.formatting import delimited_line


def text_report(df: DataFrame, header: str, line: Sequence[Column], sep: str,
                order: Sequence[str]) -> DataFrame:
    """One string column ``value``: the header first, then one line per row
    of ``df`` ordered by ``order``. The order is a global sort on an
    explicit section number and the keys (range-partitioned, no single
    task); union order alone would be no contract. Write it with
    ``single_file=True`` to keep that order in one file."""
    body = df.select(F.lit(1).alias("__section"), *order,
                     delimited_line(list(line), sep).alias("value"))
    head = df.sparkSession.range(1).select(F.lit(0).alias("__section"), F.lit(header).alias("value"))
    return (head.unionByName(body, allowMissingColumns=True)
            .orderBy("__section", *order)
            .select("value"))
