"""A shuffled join whose hot keys are dealt over several tasks.

Keys are counted first (partial counts in every task). A key with more rows
than a share of the average task is cut into salts of that many rows at most;
the lookup's row for it is repeated once per salt, and both sides are joined
on (key, salt). Nothing depends on Spark's handling of skew at run time, and
no row is dropped or counted twice.

How many keys can be that hot follows from the share: at most
``tasks * PIECES`` keys hold more than rows / (tasks * PIECES) each. So the
list of them has a proven bound and is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farepath.operators.lookup import materialize_small

#: Pieces in which an average task's rows would come.
PIECES = 8


def key_salts(fact: DataFrame, key: str, tasks: int) -> DataFrame:
    """``key`` and ``salts`` (2 or more) of the keys that one piece can't hold,
    computed once and kept in the checkpoint folder."""
    counts, _ = materialize_small(fact.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    piece = max(1, -(-total // (tasks * PIECES)))
    return (counts.filter((F.col("__n") > piece) & F.col("__key").isNotNull())
            .select("__key", F.ceil(F.col("__n") / piece).cast("int").alias("__salts")))


def salted_lookup_join(fact: DataFrame, lookup: DataFrame, fact_key: str, columns: Mapping[str, str], lookup_key: str = "LocationID",
                       strategy: str = "merge", tasks: int | None = None) -> DataFrame:
    """Inner join as :func:`.lookup.with_lookup` makes it, under the
    ``strategy`` "merge" or "shuffle_hash", hot keys salted. ``tasks`` is the
    number of shuffle partitions (the session's by default)."""
    if strategy not in ("merge", "shuffle_hash"):
        raise ValueError(f"{strategy!r} doesn't shuffle")
    tasks = tasks or int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(key_salts(fact, fact_key, tasks))  # at most tasks * PIECES rows
    # Rows of a hot key take its salts in turn, within their task.
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__salts")).cast("int"), F.lit(0))
    left = (fact.join(hot, fact[fact_key] == hot["__key"], "left").withColumn("__salt", salt).drop("__key", "__salts"))
    side = lookup.select(F.col(lookup_key).alias("__lookup_key"), *[F.col(src).alias(dst) for src, dst in columns.items()])
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))
    right = (side.join(hot, side["__lookup_key"] == hot["__key"], "left").withColumn("__lookup_salt", copies).drop("__key", "__salts"))
    return (left.join(right.hint(strategy), (left[fact_key] == right["__lookup_key"]) & (left["__salt"] == right["__lookup_salt"]))
            .drop("__salt", "__lookup_key", "__lookup_salt"))
