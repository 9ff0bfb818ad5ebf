"""Group aggregates. All of them are partial-then-final hash aggregates:
rows are combined inside each task before the shuffle, so a key holding a
third of all rows costs one pre-aggregated row per task, not a hot task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def group_means(df: DataFrame, keys: str | Sequence[str],
                measures: Mapping[str, str]) -> DataFrame:
    """Mean of each measure per group (source column -> output name)."""
    return df.groupBy(*_keys(keys)).agg(*[F.avg(src).alias(dst) for src, dst in measures.items()])


@F.pandas_udf(DoubleType())
def _mean_from_parts(total: pd.Series, count: pd.Series) -> pd.Series:
    return total / count.where(count != 0)


def group_means_udf(df: DataFrame, keys: str | Sequence[str],
                    measures: Mapping[str, str], count_column: str | None = None) -> DataFrame:
    """Means assembled from ``sum`` and ``count`` with a vectorised (Arrow)
    Python function for the division. The UDF sees only the aggregated
    rows, one per group. ``count`` skips NULLs of ``count_column`` (default:
    the first measure), so it matches ``avg`` only when the measures are
    NULL together, as after a non-NULL filter."""
    keys = _keys(keys)
    count_column = count_column or next(iter(measures))
    parts = df.groupBy(*keys).agg(
        *[F.sum(src).alias(f"__sum_{i}") for i, src in enumerate(measures)],
        F.count(count_column).alias("__n"),
    )
    return parts.select(*keys, *[
        _mean_from_parts(F.col(f"__sum_{i}"), F.col("__n")).alias(dst)
        for i, dst in enumerate(measures.values())
    ])


def group_counts(df: DataFrame, keys: str | Sequence[str], name: str = "count") -> DataFrame:
    """Rows per group; a NULL key is a group of its own."""
    return df.groupBy(*_keys(keys)).agg(F.count(F.lit(1)).alias(name))


# Amounts below this many units of money are summed in cents; a LONG holds
# them and the sums of billions of them.
_MOST_EXACT = 1e12


def group_money_sums(df: DataFrame, keys: str | Sequence[str],
                     measures: Mapping[str, str], exact_cents: bool = True,
                     scale: int = 2, inexact: Mapping[str, str] | None = None) -> DataFrame:
    """Sum of each measure per group (source column -> output name).

    With ``exact_cents`` each value is rounded to ``scale`` decimals (half
    away from zero on the binary value, so 1.005 is 1.00) and summed as a
    LONG count of cents, which is exact and independent of the order rows
    arrive in (a double sum is not), then returned as DECIMAL(38, scale).
    Use it for money with ``scale`` decimals. A group whose values are all
    NULL sums to NULL.

    NaN, infinities and amounts of 1e12 and more have no cents. ``inexact``
    (source column -> output name) asks for their own double sum, NULL where
    there are none; without it, a group that holds one sums to NULL.
    """
    keys = _keys(keys)
    if not exact_cents:
        return df.groupBy(*keys).agg(*[F.sum(src).alias(dst) for src, dst in measures.items()])
    # One test a row for amounts without cents; nearly no row has any, and
    # only then is each measure looked at for them.
    odd = ~(sum((F.abs(F.coalesce(F.col(src).cast("double"), F.lit(0.0))) for src in measures), F.lit(0.0)) < _MOST_EXACT)
    cents = df.withColumn("__odd", odd).groupBy(*keys).agg(
        *[F.sum(_units(src, scale)).alias(f"__c{i}") for i, src in enumerate(measures)],
        *[F.sum(F.when(F.col("__odd"), _rest(src))).alias(f"__x{i}") for i, src in enumerate(measures)])
    out = []
    for i, (src, dst) in enumerate(measures.items()):
        total = _amount(f"__c{i}", scale)
        if inexact is None:
            total = F.when(F.col(f"__x{i}").isNull(), total)
        out.append(total.alias(dst))
        if inexact is not None and src in inexact:
            out.append(F.col(f"__x{i}").alias(inexact[src]))
    return cents.select(*keys, *out)


def _countable(c: str):
    return F.abs(F.col(c).cast("double")) < _MOST_EXACT  # NaN is greater than any number


def _units(c: str, scale: int):
    # Plain double arithmetic: Spark's round() on a double goes through
    # BigDecimal and costs ~3x more.
    x = F.col(c).cast("double")
    return F.when(_countable(c), (F.signum(x) * F.floor(F.abs(x) * 10 ** scale + 0.5)).cast("long"))


def _rest(c: str):
    return F.when(~_countable(c), F.col(c).cast("double"))


def _amount(cents: str, scale: int):
    return (F.col(cents).cast("decimal(38,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(38,{scale})")
