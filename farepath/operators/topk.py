from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def top_k(df: DataFrame, k: int, order: Sequence[Column | str]) -> DataFrame:
    """First ``k`` rows by ``order``. Planned as TakeOrderedAndProject: each
    task keeps its own k best and only those meet in one place. Put the
    group keys last in ``order`` so that equal counts have a fixed order."""
    return df.orderBy(*order).limit(k)
