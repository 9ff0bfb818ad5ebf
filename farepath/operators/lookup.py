"""Fact-to-lookup joins and the choice of join strategy.

A lookup (zone table) is joined in one or more roles (pickup, drop-off).
Only the key and the columns a role needs are carried into the join, and
the lookup is broadcast only after its rows and bytes have been counted
(a distributed aggregate over just those columns) and are within bound.
Past the bound the join is left to the planner and AQE (sort-merge or
shuffled hash), whatever strategy was asked for; it never fails.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType

from farepath.session import ensure_checkpoint_dir

# Bounds under which a side may be broadcast: rows, and bytes as Spark
# holds them (8 bytes per field plus the variable-width values). A zone
# row is an int key and a few short strings: 265 zones are a few KB.
DEFAULT_MAX_BROADCAST_ROWS = 100_000
DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024

JOIN_STRATEGIES = ("auto", "broadcast", "merge", "shuffle_hash", "planner")

_VARIABLE_WIDTH = (StringType, BinaryType)


def size_at_most(df: DataFrame, max_rows: int,
                 max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> tuple[int, int] | None:
    """(rows, bytes) of ``df`` if it has at most ``max_rows`` rows and
    ``max_bytes`` bytes, else None. One aggregate without a limit: each
    task sends one row, so no task gathers rows however large ``df`` is;
    pass only the columns that matter. Nested values are measured by
    their JSON text."""
    fixed = 8 + 8 * len(df.schema.fields)
    var = [F.octet_length(F.col(f"`{f.name}`")) if isinstance(f.dataType, _VARIABLE_WIDTH)
           else F.octet_length(F.to_json(F.col(f"`{f.name}`")))
           for f in df.schema.fields
           if isinstance(f.dataType, _VARIABLE_WIDTH) or not isinstance(f.dataType, AtomicType)]
    row_bytes = F.lit(fixed)
    for v in var:
        row_bytes = row_bytes + F.coalesce(v, F.lit(0))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes), F.lit(0)).alias("b")).first()
    n, b = int(r["n"]), int(r["b"])
    return (n, b) if n <= max_rows and b <= max_bytes else None


def row_count_at_most(df: DataFrame, max_rows: int) -> int | None:
    """Row count if it is at most ``max_rows`` (and the rows fit the byte
    bound), else None."""
    size = size_at_most(df, max_rows)
    return size[0] if size else None


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint on ``df`` when its row count is proven within
    ``max_rows``; otherwise ``df`` unchanged."""
    return F.broadcast(df) if row_count_at_most(df, max_rows) is not None else df


def materialize_small(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS
                      ) -> tuple[DataFrame, bool]:
    """Compute a result that is expected to be small (an aggregate) once,
    into the reliable checkpoint folder, then count it there. Returns the
    checkpointed DataFrame, broadcast-hinted when the count is within
    bound, and whether it was. A later join reads the checkpoint instead
    of re-running the aggregate, and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    small = row_count_at_most(done, max_rows) is not None
    return (F.broadcast(done) if small else done), small


def _apply_strategy(side: DataFrame, strategy: str, max_rows: int) -> DataFrame:
    if strategy in ("auto", "broadcast"):
        return checked_broadcast(side, max_rows)
    if strategy in ("merge", "shuffle_hash"):
        return side.hint(strategy)
    if strategy == "verified_broadcast":  # size already checked by the caller
        return F.broadcast(side)
    if strategy == "planner":
        return side
    raise ValueError(f"unknown join strategy {strategy!r}; expected one of {JOIN_STRATEGIES}")


def with_lookup(fact: DataFrame, lookup: DataFrame, fact_key: str,
                columns: Mapping[str, str], lookup_key: str = "LocationID",
                strategy: str = "auto",
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Inner join of ``fact`` to ``lookup`` on ``fact_key = lookup_key``,
    adding the lookup columns renamed per ``columns`` (source -> new name).
    Facts whose key is absent from the lookup, or NULL, are dropped."""
    key_alias = f"__{fact_key}__key"
    side = lookup.select(F.col(lookup_key).alias(key_alias),
                         *[F.col(src).alias(dst) for src, dst in columns.items()])
    side = _apply_strategy(side, strategy, max_broadcast_rows)
    return fact.join(side, fact[fact_key] == side[key_alias], "inner").drop(key_alias)


def sample_lookup_join(fact: DataFrame, lookup: DataFrame, fact_key: str,
                       n: int, lookup_key: str = "LocationID",
                       strategy: str = "planner") -> DataFrame:
    """Join the facts to the first ``n`` lookup rows by key order; all
    columns of both sides. Ordering before the limit makes the sample
    deterministic; the limited side holds ``n`` rows by construction."""
    sample = lookup.orderBy(lookup_key).limit(n)
    if strategy in ("merge", "shuffle_hash"):
        sample = sample.hint(strategy)
    elif strategy in ("auto", "broadcast"):
        sample = F.broadcast(sample)  # bounded by n
    joined = fact.alias("t").join(sample.alias("u"), F.col(f"t.{fact_key}") == F.col(f"u.{lookup_key}"))
    # All columns of both sides; a lookup column whose name the facts
    # already use gets a "_lookup" suffix instead of a duplicate name.
    taken = set(fact.columns)
    return joined.select(
        *[F.col(f"t.`{c}`") for c in fact.columns],
        *[F.col(f"u.`{c}`").alias(f"{c}_lookup" if c in taken else c) for c in lookup.columns])


def join_roles(fact: DataFrame, lookup: DataFrame,
               roles: Sequence[tuple[str, Mapping[str, str]]], strategy: str = "auto",
               max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS, **kwargs) -> DataFrame:
    """Join one lookup in several roles, e.g. pickup and drop-off zone. The
    size of the columns that any role needs is checked once for all roles."""
    if strategy in ("auto", "broadcast"):
        key = kwargs.get("lookup_key", "LocationID")
        needed = list(dict.fromkeys([key, *(c for _, columns in roles for c in columns)]))
        small = row_count_at_most(lookup.select(*needed), max_broadcast_rows) is not None
        strategy = "verified_broadcast" if small else "planner"
    out = fact
    for fact_key, columns in roles:
        out = with_lookup(out, lookup, fact_key, columns, strategy=strategy, **kwargs)
    return out
