from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from farepath.functions._cols import ColumnOrName, as_col


def all_nonzero(*cols: ColumnOrName) -> Column:
    """True when every column is non-zero. A NULL makes the row fail the
    filter too, since ``NULL != 0`` is NULL."""
    if not cols:
        raise ValueError("all_nonzero needs at least one column")
    return reduce(lambda acc, c: acc & c, (as_col(c) != 0 for c in cols))


def all_finite(*cols: ColumnOrName) -> Column:
    """True when every column is a number, not NaN or infinite; a NULL makes
    the row fail. Spark orders NaN above infinity, so two plain comparisons
    do, and both reach the Parquet scan."""
    if not cols:
        raise ValueError("all_finite needs at least one column")
    each = ((as_col(c) < F.lit(float("inf"))) & (as_col(c) > F.lit(float("-inf"))) for c in cols)
    return reduce(lambda acc, c: acc & c, each)
