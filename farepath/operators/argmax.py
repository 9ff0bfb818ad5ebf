"""Rows reaching their group's maximum.

Plan: a partial/final aggregate computes one max per group; that small
result is checkpointed and counted, then joined back to the rows on
(group keys, value). Under the row bound the join is a broadcast hash
join, so the rows are scanned twice but never shuffled or sorted, and a
group holding a third of all rows is no hotter than any other. Past the
bound no hint is added; Spark may still broadcast the checkpoint, whose
real size it knows, under its own threshold, and otherwise shuffles the
join on (keys, value), which spreads one group's rows over many
partitions by value. A window ``max`` over the group
would instead put each group into a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farepath.operators.lookup import DEFAULT_MAX_BROADCAST_ROWS, materialize_small


def rows_at_group_max(df: DataFrame, keys: Sequence[str], value: str,
                      max_groups: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Every row whose ``value`` equals the max of its group; ties are all
    kept. Rows with a NULL key or value never match (inner join)."""
    keys = list(keys)
    # NULL keys are left out of the maxima (they could never join back).
    # No filter on the value: ``max`` skips NULLs by itself, an all-NULL
    # group's NULL maximum matches nothing, and a filter would evaluate a
    # computed value (a distance) once more per row.
    has_keys = F.lit(True)
    for k in keys:
        has_keys = has_keys & F.col(k).isNotNull()
    maxes = (df.where(has_keys).groupBy(*keys).agg(F.max(value).alias("__max"))
             .where(F.col("__max").isNotNull()))
    maxes, _ = materialize_small(maxes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                                              "__max"), max_groups)
    # The value is matched null-safely: an equality would make Catalyst add
    # ``value IS NOT NULL`` on the row side, evaluating a computed value
    # (a distance) once more per row. NULL maxima are already gone, so a
    # NULL value still matches nothing.
    cond = [df[k] == maxes[f"__k{i}"] for i, k in enumerate(keys)]
    cond.append(df[value].eqNullSafe(maxes["__max"]))
    return df.join(maxes, cond, "inner").select(*[df[c] for c in df.columns])


def one_row_per_group_max(df: DataFrame, keys: Sequence[str], value: str,
                          payload: Sequence[str], tie_break: Sequence[Column],
                          max_groups: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """One row per group at the group max. Among tied rows the one with
    the smallest ``tie_break`` tuple wins, NULL last; among rows equal in
    that too, the smallest payload.

    With one tie-break and one payload column the tied rows are combined by
    scalar ``min`` and ``min_by`` in hash aggregates, before any shuffle.
    Only a wider tuple is compared as a struct, whose aggregate sorts."""
    keys = list(keys)
    tied = rows_at_group_max(df, keys, value, max_groups)
    groups = [*keys, value]
    if len(payload) == 1 and len(tie_break) == 1:
        p, order = payload[0], tie_break[0]
        if str(order) == str(F.col(p)):  # the payload is its own tie-break
            return tied.groupBy(*groups).agg(F.min(p).alias(p))
        # The smallest payload of each tie-break value; then the payload of
        # the smallest value. ``min_by`` skips NULL tie-breaks, which win
        # only where a group has nothing else.
        least = tied.groupBy(*groups, order.alias("__tb")).agg(F.min(p).alias("__p"))
        best = F.when(F.count("__tb") > 0, F.min_by("__p", "__tb")).otherwise(F.min("__p"))
        return least.groupBy(*groups).agg(best.alias(p))
    order = []
    for i, c in enumerate(tie_break):
        order += [c.isNull().alias(f"__n{i}"), c.alias(f"__tb{i}")]
    winner = F.min(F.struct(*order, *[F.col(p) for p in payload])).alias("__w")
    return tied.groupBy(*groups).agg(winner).select(
        *groups, *[F.col(f"__w.{p}").alias(p) for p in payload])
