"""Counts of what a filter keeps and drops, taken while a job runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FilterCounts:
    read: int
    kept: int

    @property
    def dropped(self) -> int:
        return self.read - self.kept


class FilterObserver:
    """Counts the rows that reach one filter. The counts are those of the
    first job that runs the filter to its end; there is no pass of their own.
    Rows are counted before the filter, so it isn't pushed into the scan."""

    def __init__(self) -> None:
        self._seen = Observation()

    def filter(self, df: DataFrame, condition: Column) -> DataFrame:
        """``df`` filtered, its rows counted on the way; a NULL condition drops."""
        passes = F.coalesce(condition, F.lit(False))
        return df.observe(self._seen, F.count(F.lit(1)).alias("read"), F.count_if(passes).alias("kept")).filter(condition)

    @property
    def counts(self) -> FilterCounts:
        """Waits for the job if it hasn't ended."""
        return FilterCounts(**self._seen.get)


def filtered(df: DataFrame, condition: Column, observer: FilterObserver | None) -> DataFrame:
    return df.where(condition) if observer is None else observer.filter(df, condition)
