"""DataFrame-in, DataFrame-out operators built on native Spark plans."""

from farepath.operators.aggregate import (
    group_counts,
    group_means,
    group_means_udf,
    group_money_sums,
)
from farepath.operators.argmax import one_row_per_group_max, rows_at_group_max
from farepath.operators.lookup import (
    JOIN_STRATEGIES,
    checked_broadcast,
    materialize_small,
    sample_lookup_join,
    with_lookup,
)
from farepath.operators.observed import FilterCounts, FilterObserver
from farepath.operators.report import text_report
from farepath.operators.skew import salted_lookup_join
from farepath.operators.topk import top_k

__all__ = [
    "FilterCounts",
    "FilterObserver",
    "JOIN_STRATEGIES",
    "checked_broadcast",
    "group_counts",
    "group_means",
    "group_means_udf",
    "group_money_sums",
    "materialize_small",
    "one_row_per_group_max",
    "rows_at_group_max",
    "salted_lookup_join",
    "sample_lookup_join",
    "text_report",
    "top_k",
    "with_lookup",
]
