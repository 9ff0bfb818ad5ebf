"""The questions that are asked in SQL, as SQL text over DataFrames.

DataFrames are passed to ``spark.sql`` as named arguments and values as
bound parameters, so no session-wide view name and no value is pasted
into the text. Column names, which cannot be bound, are quoted with every
backtick doubled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farepath.operators.lookup import DEFAULT_MAX_BROADCAST_ROWS, materialize_small
from farepath.plans.trip_queries import (
    DURATION,
    MAX_DISTANCE,
    NIGHT_TRIPS,
    PICKUP_TIME,
    spread,
    with_distance_duration,
)
from farepath.schemas import BOROUGHS


def _array(values: Sequence[str]):
    return F.array(*[F.lit(v) for v in values])


def _quoted(name: str) -> str:
    """A column name as an identifier. Braces are doubled, as the text goes
    through Spark's placeholder formatting."""
    return "`" + name.replace("`", "``").replace("{", "{{").replace("}", "}}") + "`"


def farthest_trip_per_vendor_sql(spark: SparkSession, trips: DataFrame, vendor: str = "VendorID",
                                 max_groups: int = DEFAULT_MAX_BROADCAST_ROWS, **kw) -> DataFrame:
    """Max distance per vendor joined back on vendor and distance; ties kept.

    The maxima are computed by one SQL statement and checkpointed and
    counted like the DataFrame form's, so the join-back is a broadcast of a
    proven-small table rather than a planner estimate (which at scale is
    the size of the trips and would shuffle them). The distance is matched
    with ``<=>`` against non-NULL maxima: same rows as ``=``, but no
    inferred ``IS NOT NULL`` filter that would compute every distance
    twice."""
    dd = with_distance_duration(trips, vendor=vendor, **kw)
    v = _quoted(vendor)
    maxes = spark.sql(
        f"SELECT {v}, MAX(distance_km) AS max_distance FROM {{dd}} "
        f"WHERE {v} IS NOT NULL GROUP BY {v} HAVING MAX(distance_km) IS NOT NULL", dd=dd)
    maxes, _ = materialize_small(maxes, max_groups)
    matched = spark.sql(
        f"""
        SELECT m.{v},
               ROUND(m.max_distance, 2) AS {_quoted(MAX_DISTANCE)},
               ROUND(d.duration_min, 1) AS {_quoted(DURATION)}
        FROM {{maxes}} AS m
        JOIN {{dd}} AS d
          ON d.{v} = m.{v} AND d.distance_km <=> m.max_distance
        """,
        maxes=maxes, dd=dd,
    )
    return spark.sql(f"SELECT * FROM {{rows}} ORDER BY {v}, {_quoted(DURATION)}", rows=spread(matched))


def same_region_trip_counts_sql(spark: SparkSession, trips: DataFrame, lookup: DataFrame,
                                regions: Sequence[str] = BOROUGHS) -> DataFrame:
    """Trips are counted per zone-id pair first, so the lookup joins see
    at most zones^2 rows (the optimizer does not push an aggregate below
    a join by itself)."""
    return spark.sql(
        """
        WITH pairs AS (
          SELECT PULocationID, DOLocationID, COUNT(*) AS n
          FROM {trips} GROUP BY PULocationID, DOLocationID
        )
        SELECT pu.Borough AS Borough, SUM(p.n) AS TotalTrips
        FROM pairs AS p
        JOIN {lookup} AS pu ON p.PULocationID = pu.LocationID
        JOIN {lookup} AS dr ON p.DOLocationID = dr.LocationID
        WHERE pu.Borough = dr.Borough AND array_contains(:regions, pu.Borough)
        GROUP BY pu.Borough
        ORDER BY TotalTrips DESC, Borough
        """,
        args={"regions": _array(regions)}, trips=trips, lookup=lookup,
    )


def night_counts_sql(spark: SparkSession, df: DataFrame, time_col: str = PICKUP_TIME,
                     key: str = "VendorID", start_hour: int = 23, end_hour: int = 7,
                     name: str = NIGHT_TRIPS) -> DataFrame:
    """Wrap-around night window; both hours are bound parameters. Text times
    give their hour from the two characters after the date; text without an
    hour there drops, as in the DataFrame form."""
    cond = "h >= :start_hour OR h < :end_hour" if start_hour > end_hour \
        else "h >= :start_hour AND h < :end_hour"
    k, t = _quoted(key), _quoted(time_col)
    hour = f"HOUR({t})"
    if dict(df.dtypes)[time_col] == "string":
        text = f"SUBSTRING({t}, 12, 2)"
        hour = f"CASE WHEN {text} RLIKE '^([01][0-9]|2[0-3])$' THEN TRY_CAST({text} AS INT) END"
    return spark.sql(
        f"""
        SELECT {k}, COUNT(*) AS {_quoted(name)}
        FROM (SELECT {k}, {hour} AS h FROM {{df}}) AS hours
        WHERE {cond}
        GROUP BY {k}
        ORDER BY {k}
        """,
        args={"start_hour": start_hour, "end_hour": end_hour}, df=df,
    )


_SQL_HINTS = {None: "", "broadcast": "/*+ BROADCAST(u) */", "merge": "/*+ MERGE(u) */",
              "shuffle_hash": "/*+ SHUFFLE_HASH(u) */"}


def lookup_sample_join_sql(spark: SparkSession, trips: DataFrame, lookup_path: str,
                           n: int = 50, strategy: str | None = None) -> DataFrame:
    """Trips joined to the first ``n`` zones of a Parquet file named in the
    query itself (``parquet.`path```). ``strategy`` adds a join hint for
    this join only; the session's broadcast threshold is left alone."""
    if strategy not in _SQL_HINTS:
        raise ValueError(f"unknown join strategy {strategy!r}")
    path = _quoted(lookup_path)
    return spark.sql(
        f"""
        SELECT {_SQL_HINTS[strategy]} t.*, u.*
        FROM {{trips}} AS t
        JOIN (SELECT * FROM parquet.{path} ORDER BY LocationID LIMIT :n) AS u
          ON t.PULocationID = u.LocationID
        """,
        args={"n": n}, trips=trips,
    )
