"""Trip and zone tables derived from the driver's TPC-H-style tables.

The driver ships no taxi trips. A trip is one ``lineitem`` row with its
order, customer and supplier; a zone is one ``nation`` with its
``region`` as borough. The column rules are plain SQL text so that the
same text feeds Spark (``F.expr``) and the DuckDB oracle.

``prepared_trips`` / ``prepared_lookup`` write the derived tables once per
session into the shared scratch folder and return a Parquet scan of
them: the same shape as a trip file converted to Parquet, and a point
where lineage is cut, so a lost executor never re-runs the four-way join.
The CSV copies are such a point too: without a Parquet copy in the session
they are written straight from the join.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farepath.schemas import TRIPS_2015, TRIPS_2024, ZONE_LOOKUP
from farepath.session import file_system, new_scratch_path, session_key
from farepath.sinks.files import write_csv, write_parquet, write_text
from farepath.sinks.layout import write_bucketed, write_by_period

# Derived trip columns, as SQL over the joined tables. Times
# of day, durations (some negative, some under a minute, some missing) and
# the charges come from the keys, so every branch of the questions is met.
_SECOND_OF_DAY = "((l_orderkey * 6151 + l_linenumber * 3571) % 86400)"
_SECONDS = "((l_partkey * 37 + l_orderkey * 11 + l_linenumber) % 5400 - 300)"


def _double(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


TRIP_COLUMNS_SQL = {
    "VendorID": "l_linenumber",
    "tpep_pickup_datetime": f"o_orderdate + INTERVAL '1' SECOND * {_SECOND_OF_DAY}",
    "tpep_dropoff_datetime": (
        f"CASE WHEN l_orderkey % 41 = 0 THEN NULL "
        f"ELSE o_orderdate + INTERVAL '1' SECOND * ({_SECOND_OF_DAY} + {_SECONDS}) END"
    ),
    "passenger_count": "CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CAST(l_partkey % 6 AS INTEGER) END",
    "trip_distance": f"l_quantity / {_double('4')}",
    "RatecodeID": "CAST(l_suppkey % 5 + 1 AS INTEGER)",
    "store_and_fwd_flag": "CASE WHEN l_partkey % 10 = 0 THEN 'Y' WHEN l_partkey % 10 = 1 THEN NULL ELSE 'N' END",
    "PULocationID": "c_nationkey",
    "DOLocationID": "s_nationkey",
    "pickup_longitude": (
        "CASE WHEN l_partkey % 50 = 0 THEN CAST(0 AS DOUBLE) "
        "ELSE CAST((l_orderkey * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) "
        "- CAST(74 AS DOUBLE) END"
    ),
    "pickup_latitude": (
        "CAST((l_partkey * 104729) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) "
        "+ CAST(40 AS DOUBLE)"
    ),
    "dropoff_longitude": (
        "CAST((l_orderkey * 1299709 + l_partkey) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) "
        "- CAST(74 AS DOUBLE)"
    ),
    "dropoff_latitude": (
        "CASE WHEN l_orderkey % 83 = 0 THEN NULL "
        "ELSE CAST((l_suppkey * 15485863 + l_orderkey) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) "
        "+ CAST(40 AS DOUBLE) END"
    ),
    "payment_type": "CAST(l_orderkey % 4 + 1 AS INTEGER)",
    "fare_amount": "l_extendedprice",
    "extra": "l_quantity",
    "mta_tax": "l_tax",
    "tip_amount": "l_discount",
    "tolls_amount": f"CASE WHEN l_partkey % 8 = 0 THEN {_double('6.94')} ELSE {_double('0')} END",
    "improvement_surcharge": _double("0.3"),
    "total_amount": "o_totalprice",
    "congestion_surcharge": f"CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE {_double('2.5')} END",
    "airport_fee": f"CASE WHEN l_orderkey % 12 = 0 THEN {_double('1.75')} ELSE {_double('0')} END",
    "cbd_congestion_fee": f"CASE WHEN l_orderkey % 7 = 0 THEN {_double('0.75')} END",
}

TRIPS_FROM_SQL = (
    "lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey "
    "JOIN supplier ON l_suppkey = s_suppkey"
)

# Derived zone columns.
LOOKUP_COLUMNS_SQL = {
    "LocationID": "n_nationkey",
    "Borough": "r_name",
    "Zone": "n_name",
}

LOOKUP_FROM_SQL = "nation JOIN region ON n_regionkey = r_regionkey"

# Regions kept by the same-region and revenue questions on driver data;
# the other two play the part of a borough outside the list.
DRIVER_REGIONS = ["AFRICA", "AMERICA", "ASIA"]


def trips_sql_cte() -> str:
    """``trips`` and ``lookup`` as SQL common table expressions."""
    trip_cols = ",\n    ".join(f"{expr} AS {name}" for name, expr in TRIP_COLUMNS_SQL.items())
    lookup_cols = ", ".join(f"{expr} AS {name}" for name, expr in LOOKUP_COLUMNS_SQL.items())
    return (
        f"trips AS (\n  SELECT\n    {trip_cols}\n  FROM {TRIPS_FROM_SQL}\n),\n"
        f"lookup AS (SELECT {lookup_cols} FROM {LOOKUP_FROM_SQL})"
    )


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    region = _table(spark, sf_dir, "region")
    joined = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return joined.select(*[F.expr(e).alias(n) for n, e in LOOKUP_COLUMNS_SQL.items()])


def derive_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy derivation. Orders meet their customers first, so the line
    items, by far the largest table, are shuffled once for the order key
    and once more for the supplier key only where the suppliers are too
    many to broadcast (the planner's and AQE's choice)."""
    li = _table(spark, sf_dir, "lineitem")
    od = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    cu = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    su = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    ordered = od.join(cu, od["o_custkey"] == cu["c_custkey"]).drop("o_custkey", "c_custkey")
    joined = (li.join(ordered, li["l_orderkey"] == ordered["o_orderkey"])
              .join(su, li["l_suppkey"] == su["s_suppkey"]))
    return joined.select(*[F.expr(e).alias(n) for n, e in TRIP_COLUMNS_SQL.items()])


def _in_layout(trips: DataFrame, schema) -> DataFrame:
    """Rows in a file layout: its names and order (names match in any case,
    as in SQL), missing columns as typed NULLs."""
    have = {c.lower() for c in trips.columns}
    return trips.select(*[
        (F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


_lock = threading.RLock()
_prepared: dict[tuple[str, str, str], tuple[str, str | None]] = {}

# The tables that prepared tables are derived from.
_SOURCES = ("lineitem", "orders", "customer", "supplier", "nation", "region", "events")


def _signature(spark: SparkSession, sf_dir: str) -> str | None:
    """Names, lengths and times of the source files, from their listing."""
    parts = []
    for name in _SOURCES:
        found = file_system(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
        if found is None:
            return None
        fs, path = found
        if fs.exists(path):
            parts += [f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(path)]
    return "|".join(sorted(parts))


def _finished(spark: SparkSession, path: str) -> bool:
    """The write has ended: its success marker stands."""
    found = file_system(spark, f"{path}/_SUCCESS")
    return found is None or found[0].exists(found[1])


def _prepare(spark: SparkSession, sf_dir: str, kind: str, build) -> str:
    """Build a derived table once per session and sf folder; again if the
    source files have changed, or its folder is gone or unfinished."""
    key = (session_key(spark), sf_dir.rstrip("/"), kind)
    now = _signature(spark, sf_dir)
    with _lock:
        path, then = _prepared.get(key, (None, None))
        if path is None or then != now or not _finished(spark, path):
            path = build(new_scratch_path(spark, kind))
            _prepared[key] = (path, now)
    return path


def _known(spark: SparkSession, sf_dir: str, kind: str) -> str | None:
    """Path of a derived table that this session has built and can still use."""
    path, then = _prepared.get((session_key(spark), sf_dir.rstrip("/"), kind), (None, None))
    return path if path and then == _signature(spark, sf_dir) and _finished(spark, path) else None


def prepared_trips_path(spark: SparkSession, sf_dir: str) -> str:
    return _prepare(spark, sf_dir, "trips-parquet",
                    lambda p: write_parquet(derive_trips(spark, sf_dir), p))


def prepared_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(prepared_trips_path(spark, sf_dir))


def _trips_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trips for a writer that reads them once: of the Parquet copy if the
    session has one, else derived, so that no copy is written in between."""
    path = _known(spark, sf_dir, "trips-parquet")
    return spark.read.parquet(path) if path else derive_trips(spark, sf_dir)


def prepared_lookup_path(spark: SparkSession, sf_dir: str) -> str:
    return _prepare(spark, sf_dir, "lookup-parquet",
                    lambda p: write_parquet(derive_lookup(spark, sf_dir), p, single_file=True))


def prepared_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(prepared_lookup_path(spark, sf_dir))


def trips_csv_path(spark: SparkSession, sf_dir: str, layout: str = "2024") -> str:
    """The derived trips written as CSV in the 2015 or 2024 file layout,
    compressed (a file per task of the write, as long as its task's share)."""
    schema = {"2015": TRIPS_2015, "2024": TRIPS_2024}[layout]
    return _prepare(spark, sf_dir, f"trips-csv-{layout}",
                    lambda p: write_csv(_in_layout(_trips_once(spark, sf_dir), schema), p, compression="gzip"))


def lookup_csv_path(spark: SparkSession, sf_dir: str) -> str:
    """The derived zones written as CSV in the zone lookup layout."""
    return _prepare(spark, sf_dir, "lookup-csv",
                    lambda p: write_csv(_in_layout(prepared_lookup(spark, sf_dir), ZONE_LOOKUP),
                                        p, single_file=True))


def events_csv_path(spark: SparkSession, sf_dir: str) -> str:
    """The driver's events table written as CSV (header, microseconds kept)."""
    return _prepare(spark, sf_dir, "events-csv",
                    lambda p: write_csv(_table(spark, sf_dir, "events"), p))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")


def _event_lines(table: DataFrame) -> DataFrame:
    """The events as CSV lines, some of them broken on purpose by the rule of
    :data:`BROKEN` (shared with the oracle SQL)."""
    spaced = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("event_id", "user_id", "event_type", "value")}
    kind = F.col("event_id") % BROKEN_EVERY
    first = [texts["event_id"], F.when(kind == 3, "yesterday").otherwise(F.coalesce(spaced, F.lit("")))]
    line = F.concat_ws(",", *first, texts["user_id"], texts["event_type"], F.when(kind == 1, "n/a").otherwise(texts["value"]))
    return table.select(F.when(kind == 2, F.concat_ws(",", *first, texts["user_id"])).when(kind == 4, F.concat(line, F.lit(",more"))).otherwise(line).alias("value"))


#: One event in so many is broken, in the way of its id's remainder: 1 its
#: value is no number, 2 fields are missing, 3 its time is no time, 4 one field
#: too many.
BROKEN_EVERY = 97


def broken_events_path(spark: SparkSession, sf_dir: str) -> str:
    """Text files of the events without a header, some lines broken."""
    return _prepare(spark, sf_dir, "events-broken", lambda p: write_text(_event_lines(_table(spark, sf_dir, "events")), p))


def bucketed_tables(spark: SparkSession, sf_dir: str, buckets: int) -> tuple[str, str]:
    """Names of the derived trips and zones as tables bucketed by zone id."""
    def name(path: str) -> str:
        return "farepath_" + path.rstrip("/").rpartition("/")[2].replace("-", "_")

    def build(source, key):
        def write(path: str) -> str:
            write_bucketed(source(spark, sf_dir), path, name(path), key, buckets)
            return path
        return write

    return (name(_prepare(spark, sf_dir, f"trips-by-zone-{buckets}", build(prepared_trips, "PULocationID"))),
            name(_prepare(spark, sf_dir, f"zones-by-id-{buckets}", build(prepared_lookup, "LocationID"))))


def trips_by_month_path(spark: SparkSession, sf_dir: str) -> str:
    """The derived trips in a folder per month of pickup, sorted by time."""
    return _prepare(spark, sf_dir, "trips-by-month",
                    lambda p: write_by_period(prepared_trips(spark, sf_dir), p, "tpep_pickup_datetime", "month"))
