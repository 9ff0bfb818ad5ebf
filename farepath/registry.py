"""Queries over the driver's tables, each with its DuckDB oracle SQL.

Every query reads whole tables from ``sf_dir`` (or tables Spark derives
from them); nothing is sampled or capped except where the limit is the
question (top-k, the ordered lookup sample).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from farepath.functions import duration_minutes
from farepath.operators import FilterObserver, one_row_per_group_max, rows_at_group_max
from farepath.plans import sql_queries as sq
from farepath.plans import trip_queries as tq
from farepath.schemas import REVENUE_MEASURES, TRIPS_2015, TRIPS_2024, ZONE_LOOKUP
from farepath.session import named_scratch_path
from farepath.streaming import run_available, stream_files
from farepath.sinks.convert import conversions, convert_files
from farepath.sinks.layout import read_between
from farepath.sinks.files import IngestItem, ingest_csv_to_parquet, write_csv, write_parquet, write_text
from farepath.sources import (
    accepted,
    counts_by_reason,
    drop_header,
    parse_delimited,
    parse_delimited_checked,
    read_csv,
    read_csv_checked,
    read_csv_inferred,
    read_csv_inferred_once,
    read_delimited,
    read_lines,
    refused,
)
from farepath.sources import tables
from farepath.sources.tables import (
    DRIVER_REGIONS,
    events,
    events_csv_path,
    lookup_csv_path,
    prepared_lookup,
    prepared_lookup_path,
    prepared_trips,
    trips_csv_path,
    trips_sql_cte,
)

EVENTS_SCHEMA = StructType([
    StructField("event_id", LongType()),
    StructField("ts", TimestampNTZType()),
    StructField("user_id", LongType()),
    StructField("event_type", StringType()),
    StructField("value", DoubleType()),
    StructField("props", StringType()),
])

#: The events as lines without their JSON.
EVENT_LINE_SCHEMA = StructType(EVENTS_SCHEMA.fields[:5])
#: Buckets of the tables that are joined without a shuffle.
BUCKETS = 16
#: First and last (not included) pickup time of the date-limited question.
DATES = ("1994-03-15 00:00:00", "1995-02-02 12:00:00")
EVENT_MEASURES = {"value": "MeanValue", "user_id": "MeanUserId"}
LOOKUP_SAMPLE_ROWS = 10
TOP_PAIRS = 4
# Files of the replayed stream that a micro-batch reads.
STREAM_FILES_PER_BATCH = 4
COORDS = ["pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude"]
# (position, name, type) of the fields the text parser keeps, 2015 layout.
TEXT_FIELDS = [(0, "VendorID", "int"), (1, "tpep_pickup_datetime", "timestamp_ntz"),
               (2, "tpep_dropoff_datetime", "timestamp_ntz"), (5, "pickup_longitude", "double"),
               (6, "pickup_latitude", "double"), (9, "dropoff_longitude", "double"),
               (10, "dropoff_latitude", "double")]


def _trips(spark, sf):
    return prepared_trips(spark, sf)


def _lookup(spark, sf):
    return prepared_lookup(spark, sf)


def _csv_trips_2015(spark, sf, **kw):
    return read_csv(spark, trips_csv_path(spark, sf, "2015"), TRIPS_2015, **kw)


def _csv_trips_2024(spark, sf):
    return read_csv(spark, trips_csv_path(spark, sf, "2024"), TRIPS_2024)


def _csv_lookup(spark, sf):
    return read_csv(spark, lookup_csv_path(spark, sf), ZONE_LOOKUP)


def _text_trips(spark, sf):
    lines = drop_header(read_lines(spark, trips_csv_path(spark, sf, "2015")))
    return parse_delimited(lines, TEXT_FIELDS)


# Spark side ------------------------------------------------------------------

def q_hour_of_day_means(spark, sf):
    return tq.hour_of_day_means(events(spark, sf), "ts", EVENT_MEASURES, decimals=6)


def q_hour_of_day_means_udf(spark, sf):
    return tq.hour_of_day_means(events(spark, sf), "ts", EVENT_MEASURES, decimals=6, use_udf=True)


def q_hour_of_day_means_text(spark, sf):
    # Events CSV read as delimited text: only time text, user and value are
    # typed; the JSON column at the end is never parsed.
    fields = [(1, "ts", "string"), (2, "user_id", "bigint"), (4, "value", "double")]
    ev = read_delimited(spark, events_csv_path(spark, sf), fields)
    return tq.hour_of_day_means(ev, "ts", EVENT_MEASURES, decimals=6)


def q_pickup_hour_means(spark, sf):
    # The trip form: mean pickup longitude and latitude per pickup hour,
    # zero coordinates left out (the derived trips have some on purpose).
    return tq.hour_of_day_means(_trips(spark, sf), decimals=6)


def q_night_trip_counts(spark, sf):
    return tq.night_counts(_trips(spark, sf))


def q_night_trip_counts_sql(spark, sf):
    return sq.night_counts_sql(spark, _trips(spark, sf))


def q_hour_means_report(spark, sf):
    fields = [(1, "ts", "string"), (2, "user_id", "bigint"), (4, "value", "double")]
    ev = read_delimited(spark, events_csv_path(spark, sf), fields)
    means = tq.hour_of_day_means(ev, "ts", EVENT_MEASURES)
    return tq.hour_means_report(means.select(tq.HOUR, *EVENT_MEASURES.values()))


def q_night_trip_counts_csv(spark, sf):
    # SQL over the trip CSV read with the fixed 2024 schema, two columns.
    trips = read_csv(spark, trips_csv_path(spark, sf, "2024"), TRIPS_2024,
                     columns=["tpep_pickup_datetime", "VendorID"])
    return sq.night_counts_sql(spark, trips)


def q_night_event_counts(spark, sf):
    return tq.night_counts(events(spark, sf), "ts", "event_type", name="NightEvents")


def q_night_event_counts_sql(spark, sf):
    return sq.night_counts_sql(spark, events(spark, sf), "ts", "event_type", name="NightEvents")


def q_night_event_counts_csv(spark, sf):
    ev = read_csv(spark, events_csv_path(spark, sf), EVENTS_SCHEMA, columns=["ts", "event_type"])
    return tq.night_counts(ev, "ts", "event_type", name="NightEvents")


def q_same_region(spark, sf):
    return tq.same_region_trip_counts(_trips(spark, sf), _lookup(spark, sf), DRIVER_REGIONS)


def q_same_region_sql(spark, sf):
    return sq.same_region_trip_counts_sql(spark, _trips(spark, sf), _lookup(spark, sf), DRIVER_REGIONS)


def q_same_region_csv(spark, sf):
    return tq.same_region_trip_counts(_csv_trips_2024(spark, sf), _csv_lookup(spark, sf), DRIVER_REGIONS)


def q_zone_pairs(spark, sf):
    return tq.zone_pair_counts(_trips(spark, sf), _lookup(spark, sf))


def q_zone_pairs_csv(spark, sf):
    return tq.zone_pair_counts(_csv_trips_2024(spark, sf), _csv_lookup(spark, sf))


def q_zone_pair_top(spark, sf):
    return tq.zone_pair_top(_trips(spark, sf), _lookup(spark, sf), k=TOP_PAIRS)


def q_region_revenue(spark, sf):
    return tq.region_revenue(_trips(spark, sf), _lookup(spark, sf), DRIVER_REGIONS,
                             REVENUE_MEASURES, order_measure="total_amount")


def q_haversine(spark, sf):
    dd = tq.with_distance_duration(_trips(spark, sf))
    return dd.select("VendorID", *COORDS, F.round("distance_km", 6).alias("distance_km"))


def q_duration(spark, sf):
    t = _trips(spark, sf)
    return t.select("VendorID", "PULocationID", "DOLocationID",
                    duration_minutes(tq.PICKUP_TIME, tq.DROPOFF_TIME).alias("duration_min"))


def q_farthest(spark, sf):
    return tq.farthest_trip_per_vendor(_trips(spark, sf))


def q_farthest_sql(spark, sf):
    return sq.farthest_trip_per_vendor_sql(spark, _trips(spark, sf))


def q_farthest_one(spark, sf):
    return tq.farthest_trip_one_per_vendor(_trips(spark, sf))


def q_max_quantity(spark, sf):
    t = _trips(spark, sf).select("VendorID", "extra", "fare_amount", "PULocationID", "DOLocationID")
    return rows_at_group_max(t, ["VendorID"], "extra")


def q_max_quantity_one(spark, sf):
    t = _trips(spark, sf).select("VendorID", "extra", "fare_amount")
    # Among tied quantities the highest fare wins.
    return one_row_per_group_max(t, ["VendorID"], "extra", payload=["fare_amount"],
                                 tie_break=[-F.col("fare_amount")])


def _join_strategy(strategy):
    def q(spark, sf):
        return tq.lookup_join_counts(_trips(spark, sf), _lookup(spark, sf), strategy)
    return q


def q_lookup_sample(spark, sf):
    return tq.lookup_sample(_trips(spark, sf), _lookup(spark, sf), n=LOOKUP_SAMPLE_ROWS)


def q_lookup_sample_count(spark, sf):
    return tq.lookup_sample_count(_trips(spark, sf), _lookup(spark, sf), n=LOOKUP_SAMPLE_ROWS, strategy="merge")


def q_lookup_sample_sql(spark, sf):
    return sq.lookup_sample_join_sql(spark, _trips(spark, sf), prepared_lookup_path(spark, sf),
                                     n=LOOKUP_SAMPLE_ROWS)


def q_csv_scan_schema(spark, sf):
    return _csv_trips_2024(spark, sf)


def q_csv_scan_schema_2015(spark, sf):
    return _csv_trips_2015(spark, sf)


def _typed_times(df: DataFrame) -> DataFrame:
    """Inference gives zoned timestamps; all other types stay as inferred."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in (tq.PICKUP_TIME, tq.DROPOFF_TIME)})


def q_csv_scan_inferred(spark, sf):
    return _typed_times(read_csv_inferred(spark, trips_csv_path(spark, sf, "2015")))


def q_csv_round_trip(spark, sf):
    # Written in every run, over the output of the one before, and read back.
    path = write_csv(events(spark, sf), named_scratch_path(spark, "events-csv"), mode="overwrite")
    return read_csv(spark, path, EVENTS_SCHEMA)


def q_csv_overwrite(spark, sf):
    # A result written as one CSV file with a header, over an earlier one
    # that had other rows, and read back.
    path = named_scratch_path(spark, "hour-means-csv")
    means = q_hour_of_day_means(spark, sf)
    write_csv(means.limit(1), path, mode="overwrite", single_file=True)
    write_csv(means, path, mode="overwrite", single_file=True)
    return read_csv(spark, path, means.schema)


# The file conversion: each file by its own schema rule. Each run overwrites
# the output of the one before.

_INGEST_RULES = {
    "trips_2024": (lambda spark, sf: trips_csv_path(spark, sf, "2024"), TRIPS_2024),
    "trips_2015": (lambda spark, sf: trips_csv_path(spark, sf, "2015"), None),
    "zones": (lookup_csv_path, None),
}


def _ingest_item(spark, sf, base, name):
    # Only the file that is asked for is written.
    source, schema = _INGEST_RULES[name]
    return IngestItem(source(spark, sf), f"{base}/{name}", schema)


def _ingested(spark, sf, name):
    item = _ingest_item(spark, sf, named_scratch_path(spark, "ingest"), name)
    return spark.read.parquet(*ingest_csv_to_parquet(spark, [item], mode="overwrite"))


def q_parquet_ingest_files(spark, sf):
    # All three files in one run, each under its own rule, as concurrent jobs.
    base = named_scratch_path(spark, "ingest-files")
    items = [_ingest_item(spark, sf, base, name) for name in _INGEST_RULES]
    done = convert_files(spark, items, f"{base}-manifest", again=True)
    failed = [d.error for d in done if d.error]
    if failed:
        raise RuntimeError("; ".join(failed))
    return conversions(spark, done)


def q_parquet_ingest(spark, sf):
    return _ingested(spark, sf, "trips_2024")


def q_parquet_ingest_2015(spark, sf):
    return _typed_times(_ingested(spark, sf, "trips_2015"))


def q_parquet_ingest_zones(spark, sf):
    return _ingested(spark, sf, "zones")


def q_text_lines_parse(spark, sf):
    return _text_trips(spark, sf)


def q_text_report(spark, sf):
    # The lines are parsed once into typed columns; the two passes of the
    # question read those. Written as one ordered text file, read back.
    parsed = read_delimited(spark, trips_csv_path(spark, sf, "2015"), TEXT_FIELDS)
    path = write_parquet(tq.with_distance_duration(parsed).select("VendorID", "distance_km", "duration_min"),
                         named_scratch_path(spark, "text-distances"), mode="overwrite")
    one = tq.farthest_one_of(spark.read.parquet(path), ordered=False)
    report = write_text(tq.farthest_trip_report(one), named_scratch_path(spark, "report"),
                        mode="overwrite", single_file=True)
    return read_lines(spark, report)


# C1, C2 and C3 on CSV trips.

def q_pickup_hour_means_csv(spark, sf):
    return tq.hour_of_day_means(_csv_trips_2015(spark, sf), decimals=6)


def q_pickup_hour_means_inferred(spark, sf):
    return tq.hour_of_day_means(read_csv_inferred(spark, trips_csv_path(spark, sf, "2015")), decimals=6)


def q_pickup_hour_report(spark, sf):
    # Text lines, coordinates typed, the hour taken from the time's text.
    fields = [(1, tq.PICKUP_TIME, "string"), (5, "pickup_longitude", "double"), (6, "pickup_latitude", "double")]
    trips = read_delimited(spark, trips_csv_path(spark, sf, "2015"), fields)
    return tq.hour_means_report(tq.hour_of_day_means(trips))


def q_farthest_csv(spark, sf):
    return tq.farthest_trip_per_vendor(_csv_trips_2015(spark, sf))


def q_farthest_csv_sql(spark, sf):
    return sq.farthest_trip_per_vendor_sql(spark, _csv_trips_2015(spark, sf))


def q_same_region_csv_sql(spark, sf):
    return sq.same_region_trip_counts_sql(spark, _csv_trips_2024(spark, sf), _csv_lookup(spark, sf), DRIVER_REGIONS)


def q_zone_pairs_streaming(spark, sf):
    # The prepared trip files replayed as a stream, some files a
    # micro-batch; the counts carry over in the state.
    path = tables.prepared_trips_path(spark, sf)
    stream = stream_files(spark, path, spark.read.parquet(path).schema, max_files_per_trigger=STREAM_FILES_PER_BATCH)
    counts = tq.zone_pair_counts(stream, _lookup(spark, sf))
    return spark.read.parquet(run_available(counts))


def q_csv_refused(spark, sf):
    # Lines broken on purpose, read as CSV: how many are accepted, how many
    # refused for which reason.
    schema = EVENT_LINE_SCHEMA
    checked = read_csv_checked(spark, tables.broken_events_path(spark, sf), schema, header=False)
    return counts_by_reason(checked, refused(checked, schema))


def q_csv_accepted(spark, sf):
    return accepted(read_csv_checked(spark, tables.broken_events_path(spark, sf), EVENT_LINE_SCHEMA, header=False))


def q_text_refused(spark, sf):
    # The same lines split by expressions: the refused ones themselves.
    fields = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(EVENT_LINE_SCHEMA.fields)]
    checked = parse_delimited_checked(read_lines(spark, tables.broken_events_path(spark, sf)), fields)
    return checked.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("rows"), F.max(F.length("_refused_line")).alias("longest"))


def q_hour_filter_counts(spark, sf):
    # What the filters of the hour means and of the distances keep and drop,
    # observed while the results are written.
    rows = []
    for name, build in (("hour_of_day_means", lambda o: tq.hour_of_day_means(_trips(spark, sf), observer=o)),
                        ("farthest_trip", lambda o: tq.with_distance_duration(_trips(spark, sf), observer=o).select("VendorID", "distance_km"))):
        observer = FilterObserver()
        write_parquet(build(observer), named_scratch_path(spark, f"observed-{name}"), mode="overwrite")
        counts = observer.counts
        rows.append((name, counts.read, counts.kept, counts.dropped))
    return spark.createDataFrame(rows, "question string, read long, kept long, dropped long")


def q_join_salted(spark, sf):
    return tq.salted_join_counts(_trips(spark, sf), _lookup(spark, sf), "merge")


def q_join_salted_hash(spark, sf):
    return tq.salted_join_counts(_trips(spark, sf), _lookup(spark, sf), "shuffle_hash")


def q_join_bucketed(spark, sf):
    return tq.bucketed_join_counts(spark, *tables.bucketed_tables(spark, sf, BUCKETS))


def q_trips_between(spark, sf):
    # A date-limited question on the layout by month.
    trips = read_between(spark, tables.trips_by_month_path(spark, sf), tq.PICKUP_TIME, *DATES, unit="month")
    return tq.night_counts(trips)


def q_csv_scan_inferred_stored(spark, sf):
    path = trips_csv_path(spark, sf, "2015")
    return _typed_times(read_csv_inferred_once(spark, path, named_scratch_path(spark, "inferred-schemas")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "hour_of_day_means": q_hour_of_day_means,
    "hour_of_day_means_udf": q_hour_of_day_means_udf,
    "hour_of_day_means_text": q_hour_of_day_means_text,
    "hour_means_report": q_hour_means_report,
    "pickup_hour_means": q_pickup_hour_means,
    "night_trip_counts": q_night_trip_counts,
    "night_trip_counts_sql": q_night_trip_counts_sql,
    "night_trip_counts_csv": q_night_trip_counts_csv,
    "night_event_counts": q_night_event_counts,
    "night_event_counts_sql": q_night_event_counts_sql,
    "night_event_counts_csv": q_night_event_counts_csv,
    "same_region_trip_counts": q_same_region,
    "same_region_trip_counts_sql": q_same_region_sql,
    "same_region_trip_counts_csv": q_same_region_csv,
    "zone_pair_counts": q_zone_pairs,
    "zone_pair_counts_csv": q_zone_pairs_csv,
    "zone_pair_top": q_zone_pair_top,
    "zone_pair_counts_streaming": q_zone_pairs_streaming,
    "region_revenue": q_region_revenue,
    "haversine_distance": q_haversine,
    "trip_duration_minutes": q_duration,
    "farthest_trip_per_vendor": q_farthest,
    "farthest_trip_per_vendor_sql": q_farthest_sql,
    "farthest_trip_one_per_vendor": q_farthest_one,
    "max_quantity_trips_per_vendor": q_max_quantity,
    "max_quantity_one_per_vendor": q_max_quantity_one,
    "join_broadcast": _join_strategy("broadcast"),
    "join_sort_merge": _join_strategy("merge"),
    "join_shuffle_hash": _join_strategy("shuffle_hash"),
    "lookup_sample_join": q_lookup_sample,
    "lookup_sample_join_sql": q_lookup_sample_sql,
    "lookup_sample_join_count": q_lookup_sample_count,
    "csv_scan_schema": q_csv_scan_schema,
    "csv_scan_schema_2015": q_csv_scan_schema_2015,
    "csv_scan_inferred": q_csv_scan_inferred,
    "csv_round_trip": q_csv_round_trip,
    "csv_overwrite_single_file": q_csv_overwrite,
    "parquet_ingest": q_parquet_ingest,
    "parquet_ingest_2015": q_parquet_ingest_2015,
    "parquet_ingest_zones": q_parquet_ingest_zones,
    "parquet_ingest_files": q_parquet_ingest_files,
    "pickup_hour_means_csv": q_pickup_hour_means_csv,
    "pickup_hour_means_inferred": q_pickup_hour_means_inferred,
    "pickup_hour_report": q_pickup_hour_report,
    "farthest_trip_per_vendor_csv": q_farthest_csv,
    "farthest_trip_per_vendor_csv_sql": q_farthest_csv_sql,
    "same_region_trip_counts_csv_sql": q_same_region_csv_sql,
    "csv_refused_rows": q_csv_refused,
    "csv_accepted_rows": q_csv_accepted,
    "text_refused_rows": q_text_refused,
    "filter_counts": q_hour_filter_counts,
    "join_salted_merge": q_join_salted,
    "join_salted_hash": q_join_salted_hash,
    "join_bucketed": q_join_bucketed,
    "night_trip_counts_between": q_trips_between,
    "csv_scan_inferred_stored": q_csv_scan_inferred_stored,
    "text_lines_parse": q_text_lines_parse,
    "text_report": q_text_report,
}


# Oracle side (DuckDB SQL over the driver's views) ------------------------------

def _d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = 6378.0) -> str:
    p1, p2 = f"radians({lat1})", f"radians({lat2})"
    hlat = f"((radians({lat2}) - radians({lat1})) / {_d(2)})"
    hlon = f"((radians({lon2}) - radians({lon1})) / {_d(2)})"
    a0 = (f"(sin({hlat}) * sin({hlat}) + cos({p1}) * cos({p2}) * sin({hlon}) * sin({hlon}))")
    a = f"(CASE WHEN {a0} < 0 THEN {_d(0)} WHEN {a0} > 1 THEN {_d(1)} ELSE {a0} END)"
    return f"({_d(radius)} * {_d(2)} * atan2(sqrt({a}), sqrt({_d(1)} - {a})))"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([trips_sql_cte(), *ctes]) + "\n"


_REGIONS_SQL = ", ".join(f"'{r}'" for r in DRIVER_REGIONS)
_NONZERO_SQL = " AND ".join(f"{c} <> 0 AND isfinite({c})" for c in COORDS)
_DURATION_SQL = (f"CAST(date_diff('second', tpep_pickup_datetime, tpep_dropoff_datetime) AS DOUBLE)"
                 f" / {_d(60)}")
_DD_CTE = (f"dd AS (SELECT VendorID, {haversine_sql(*COORDS)} AS distance_km, "
           f"{_DURATION_SQL} AS duration_min FROM trips WHERE {_NONZERO_SQL})")
_TAB3 = "chr(9) || chr(9) || chr(9)"

_HOUR_MEANS_SQL = """
SELECT CAST(hour(ts) AS INTEGER) AS HourofDay,
       ROUND(AVG(value), 6) AS MeanValue,
       ROUND(AVG(user_id), 6) AS MeanUserId
FROM events WHERE value <> 0 AND user_id <> 0
GROUP BY 1 ORDER BY 1
"""

_PICKUP_HOUR_SQL = _with() + """
SELECT CAST(hour(tpep_pickup_datetime) AS INTEGER) AS HourofDay,
       ROUND(AVG(pickup_longitude), 6) AS Longitude,
       ROUND(AVG(pickup_latitude), 6) AS Latitude
FROM trips WHERE pickup_longitude <> 0 AND pickup_latitude <> 0
GROUP BY 1 ORDER BY 1
"""

_HOUR_REPORT_SQL = """
SELECT value FROM (
  SELECT 0 AS section, NULL AS h,
         'HourOfDay' || chr(9) || chr(9) || 'MeanValue' || chr(9) || chr(9) || 'MeanUserId' AS value
  UNION ALL
  SELECT 1, h, CAST(h AS VARCHAR) || chr(9) || chr(9) || printf('%.6f', ROUND(mv, 6))
               || chr(9) || chr(9) || printf('%.6f', ROUND(mu, 6))
  FROM (SELECT CAST(hour(ts) AS INTEGER) AS h, AVG(value) AS mv, AVG(user_id) AS mu
        FROM events WHERE value <> 0 AND user_id <> 0 GROUP BY 1)
) ORDER BY section, h
"""

_NIGHT_TRIPS_SQL = _with() + """
SELECT VendorID, COUNT(*) AS NightTrips
FROM trips WHERE hour(tpep_pickup_datetime) >= 23 OR hour(tpep_pickup_datetime) < 7
GROUP BY VendorID ORDER BY VendorID
"""

_NIGHT_SQL = """
SELECT event_type, COUNT(*) AS NightEvents
FROM events WHERE hour(ts) >= 23 OR hour(ts) < 7
GROUP BY event_type ORDER BY event_type
"""

_SAME_REGION_SQL = _with() + f"""
SELECT pu.Borough AS Borough, COUNT(*) AS TotalTrips
FROM trips t
JOIN lookup pu ON t.PULocationID = pu.LocationID
JOIN lookup dr ON t.DOLocationID = dr.LocationID
WHERE pu.Borough = dr.Borough AND pu.Borough IN ({_REGIONS_SQL})
GROUP BY pu.Borough ORDER BY TotalTrips DESC, Borough
"""

_ZONE_PAIRS_SQL = _with() + """
SELECT pu.Zone AS "Pickup Zone", dr.Zone AS "Dropoff Zone", COUNT(*) AS TotalTrips
FROM trips t
JOIN lookup pu ON t.PULocationID = pu.LocationID
JOIN lookup dr ON t.DOLocationID = dr.LocationID
WHERE pu.Zone <> dr.Zone
GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2
"""

_money = ",\n       ".join(
    f"format('{{:,.2f}}', SUM(CAST({m} AS DECIMAL(18,2)))) AS \"{label}\""
    for m, label in REVENUE_MEASURES.items())
_REVENUE_SQL = _with() + f"""
SELECT l.Borough AS Borough,
       {_money}
FROM trips t JOIN lookup l ON t.PULocationID = l.LocationID
WHERE l.Borough IN ({_REGIONS_SQL})
GROUP BY l.Borough
ORDER BY SUM(CAST(total_amount AS DECIMAL(18,2))) DESC, Borough
"""

_HAVERSINE_SQL = _with() + f"""
SELECT VendorID, {", ".join(COORDS)},
       ROUND({haversine_sql(*COORDS)}, 6) AS distance_km
FROM trips WHERE {_NONZERO_SQL}
"""

_DURATION_QUERY_SQL = _with() + f"""
SELECT VendorID, PULocationID, DOLocationID, {_DURATION_SQL} AS duration_min FROM trips
"""

_FARTHEST_SQL = _with(_DD_CTE, "m AS (SELECT VendorID, MAX(distance_km) AS max_distance "
                               "FROM dd GROUP BY VendorID)") + """
SELECT m.VendorID,
       ROUND(m.max_distance, 2) AS "Max Haversine Distance (km)",
       ROUND(dd.duration_min, 1) AS "Duration (min)"
FROM m JOIN dd ON dd.VendorID = m.VendorID AND dd.distance_km = m.max_distance
ORDER BY 1
"""

_ONE_CTE = ("one AS (SELECT VendorID, distance_km, duration_min FROM ("
            "SELECT *, ROW_NUMBER() OVER (PARTITION BY VendorID "
            "ORDER BY distance_km DESC, duration_min ASC NULLS LAST) AS rn FROM dd "
            "WHERE VendorID IS NOT NULL) WHERE rn = 1)")

_FARTHEST_ONE_SQL = _with(_DD_CTE, _ONE_CTE) + """
SELECT VendorID,
       ROUND(distance_km, 2) AS "Max Haversine Distance (km)",
       ROUND(duration_min, 1) AS "Duration (min)"
FROM one ORDER BY 1
"""

_MAX_QTY_SQL = _with("m AS (SELECT VendorID, MAX(extra) AS extra FROM trips "
                     "WHERE VendorID IS NOT NULL GROUP BY VendorID)") + """
SELECT t.VendorID, t.extra, t.fare_amount, t.PULocationID, t.DOLocationID
FROM trips t JOIN m ON t.VendorID = m.VendorID AND t.extra = m.extra
"""

_MAX_QTY_ONE_SQL = _with() + """
SELECT VendorID, extra, fare_amount FROM (
  SELECT VendorID, extra, fare_amount,
         ROW_NUMBER() OVER (PARTITION BY VendorID ORDER BY extra DESC, fare_amount DESC) AS rn
  FROM trips WHERE VendorID IS NOT NULL AND extra IS NOT NULL) WHERE rn = 1
"""

_JOIN_COUNTS_SQL = _with() + """
SELECT l.LocationID AS LocationID, l.Zone AS Zone, COUNT(*) AS trips
FROM trips t JOIN lookup l ON t.PULocationID = l.LocationID
GROUP BY 1, 2
"""

_LOOKUP_SAMPLE_SQL = _with() + f"""
SELECT t.*, u.*
FROM trips t
JOIN (SELECT * FROM lookup ORDER BY LocationID LIMIT {LOOKUP_SAMPLE_ROWS}) u
  ON t.PULocationID = u.LocationID
"""

_TRIPS_2024_SQL = _with() + "SELECT " + ", ".join(f'{f.name} AS "{f.name}"' for f in TRIPS_2024.fields) + " FROM trips"

_TRIPS_2015_SQL = _with() + "SELECT " + ", ".join(f'{f.name} AS "{f.name}"' for f in TRIPS_2015.fields) + " FROM trips"

_ZONES_SQL = _with() + "SELECT LocationID, Borough, Zone, CAST(NULL AS VARCHAR) AS service_zone FROM lookup"

def _columns_sql(file: str, table: str, columns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{file}' AS file, (SELECT count(*) FROM {table}) AS rows, CAST({i} AS INTEGER) AS place, '{name}' AS \"column\", '{kind}' AS type"
        for i, (name, kind) in enumerate(columns))


# Types that inference gives for these files: whole numbers as int, times zoned.
_INFERRED_2015 = [(f.name, {"timestamp_ntz": "timestamp"}.get(f.dataType.simpleString(), f.dataType.simpleString())) for f in TRIPS_2015.fields]
_INGEST_FILES_SQL = _with() + " UNION ALL ".join([
    _columns_sql("trips_2024", "trips", [(f.name, f.dataType.simpleString()) for f in TRIPS_2024.fields]),
    _columns_sql("trips_2015", "trips", _INFERRED_2015),
    _columns_sql("zones", "lookup", [(f.name, f.dataType.simpleString()) for f in ZONE_LOOKUP.fields])])

_REFUSED_SQL = f"""
WITH lines AS (
  SELECT *, CASE event_id % {tables.BROKEN_EVERY} WHEN 1 THEN 'value is not double' WHEN 2 THEN 'too few fields'
                 WHEN 3 THEN 'ts is not timestamp_ntz' WHEN 4 THEN 'too many fields' END AS reason,
         concat_ws(',', event_id, CASE WHEN event_id % {tables.BROKEN_EVERY} = 3 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END, user_id)
         || CASE WHEN event_id % {tables.BROKEN_EVERY} = 2 THEN '' ELSE ',' || coalesce(event_type, '') || ','
                 || CASE WHEN event_id % {tables.BROKEN_EVERY} = 1 THEN 'n/a' ELSE coalesce(CAST(value AS VARCHAR), '') END END AS line
  FROM events)
"""

_FILTER_COUNTS_SQL = _with() + f"""
SELECT question, read, kept, read - kept AS dropped FROM (
  SELECT 'hour_of_day_means' AS question, count(*) AS read, count(*) FILTER (WHERE pickup_longitude <> 0 AND pickup_latitude <> 0) AS kept FROM trips
  UNION ALL
  SELECT 'farthest_trip', count(*), count(*) FILTER (WHERE {_NONZERO_SQL}) FROM trips)
"""

_NIGHT_BETWEEN_SQL = _with() + f"""
SELECT VendorID, count(*) AS NightTrips FROM trips
WHERE (hour(tpep_pickup_datetime) >= 23 OR hour(tpep_pickup_datetime) < 7)
  AND tpep_pickup_datetime >= TIMESTAMP '{DATES[0]}' AND tpep_pickup_datetime < TIMESTAMP '{DATES[1]}'
GROUP BY 1 ORDER BY 1
"""

_PICKUP_REPORT_SQL = _with() + """
SELECT value FROM (
  SELECT 0 AS section, NULL AS h,
         'HourOfDay' || chr(9) || chr(9) || 'Longitude' || chr(9) || chr(9) || 'Latitude' AS value
  UNION ALL
  SELECT 1, h, CAST(h AS VARCHAR) || chr(9) || chr(9) || printf('%.6f', ROUND(lon, 6))
               || chr(9) || chr(9) || printf('%.6f', ROUND(lat, 6))
  FROM (SELECT CAST(hour(tpep_pickup_datetime) AS INTEGER) AS h,
               AVG(pickup_longitude) AS lon, AVG(pickup_latitude) AS lat
        FROM trips WHERE pickup_longitude <> 0 AND pickup_latitude <> 0 GROUP BY 1)
) ORDER BY section, h
"""

_TEXT_PARSE_SQL = _with() + "SELECT " + ", ".join(name for _, name, _ in TEXT_FIELDS) + " FROM trips"

_TEXT_REPORT_SQL = _with(_DD_CTE, _ONE_CTE) + f"""
SELECT value FROM (
  SELECT 0 AS section, NULL AS VendorID,
         'VendorID' || chr(9) || 'Max Haversine Distance (km)' || chr(9) || 'Duration (min)' AS value
  UNION ALL
  SELECT 1, VendorID,
         CAST(VendorID AS VARCHAR) || {_TAB3} || printf('%.2f', ROUND(distance_km, 2))
         || {_TAB3} || printf('%.1f', ROUND(duration_min, 1))
  FROM one
) ORDER BY section, VendorID
"""

ORACLE_SQL: dict[str, str] = {
    "hour_of_day_means": _HOUR_MEANS_SQL,
    "hour_of_day_means_udf": _HOUR_MEANS_SQL,
    "hour_of_day_means_text": _HOUR_MEANS_SQL,
    "hour_means_report": _HOUR_REPORT_SQL,
    "pickup_hour_means": _PICKUP_HOUR_SQL,
    "night_trip_counts": _NIGHT_TRIPS_SQL,
    "night_trip_counts_sql": _NIGHT_TRIPS_SQL,
    "night_trip_counts_csv": _NIGHT_TRIPS_SQL,
    "night_event_counts": _NIGHT_SQL,
    "night_event_counts_sql": _NIGHT_SQL,
    "night_event_counts_csv": _NIGHT_SQL,
    "same_region_trip_counts": _SAME_REGION_SQL,
    "same_region_trip_counts_sql": _SAME_REGION_SQL,
    "same_region_trip_counts_csv": _SAME_REGION_SQL,
    "zone_pair_counts": _ZONE_PAIRS_SQL,
    "zone_pair_counts_csv": _ZONE_PAIRS_SQL,
    "zone_pair_counts_streaming": _ZONE_PAIRS_SQL,
    "zone_pair_top": _ZONE_PAIRS_SQL.rstrip() + f"\nLIMIT {TOP_PAIRS}\n",
    "region_revenue": _REVENUE_SQL,
    "haversine_distance": _HAVERSINE_SQL,
    "trip_duration_minutes": _DURATION_QUERY_SQL,
    "farthest_trip_per_vendor": _FARTHEST_SQL,
    "farthest_trip_per_vendor_sql": _FARTHEST_SQL,
    "farthest_trip_one_per_vendor": _FARTHEST_ONE_SQL,
    "max_quantity_trips_per_vendor": _MAX_QTY_SQL,
    "max_quantity_one_per_vendor": _MAX_QTY_ONE_SQL,
    "join_broadcast": _JOIN_COUNTS_SQL,
    "join_sort_merge": _JOIN_COUNTS_SQL,
    "join_shuffle_hash": _JOIN_COUNTS_SQL,
    "lookup_sample_join": _LOOKUP_SAMPLE_SQL,
    "lookup_sample_join_sql": _LOOKUP_SAMPLE_SQL,
    "lookup_sample_join_count": "SELECT COUNT(*) AS \"rows\" FROM (" + _LOOKUP_SAMPLE_SQL + ") AS j",
    "csv_scan_schema": _TRIPS_2024_SQL,
    "csv_scan_schema_2015": _TRIPS_2015_SQL,
    "csv_scan_inferred": _TRIPS_2015_SQL,
    "csv_round_trip": "SELECT * FROM events",
    "csv_overwrite_single_file": _HOUR_MEANS_SQL,
    "parquet_ingest": _TRIPS_2024_SQL,
    "parquet_ingest_2015": _TRIPS_2015_SQL,
    "parquet_ingest_zones": _ZONES_SQL,
    "parquet_ingest_files": _INGEST_FILES_SQL,
    "pickup_hour_means_csv": _PICKUP_HOUR_SQL,
    "pickup_hour_means_inferred": _PICKUP_HOUR_SQL,
    "pickup_hour_report": _PICKUP_REPORT_SQL,
    "farthest_trip_per_vendor_csv": _FARTHEST_SQL,
    "farthest_trip_per_vendor_csv_sql": _FARTHEST_SQL,
    "same_region_trip_counts_csv_sql": _SAME_REGION_SQL,
    "csv_refused_rows": _REFUSED_SQL + "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS rows FROM lines GROUP BY 1",
    "csv_accepted_rows": _REFUSED_SQL + "SELECT event_id, ts, user_id, event_type, value FROM lines WHERE reason IS NULL",
    "text_refused_rows": _REFUSED_SQL + "SELECT reason, count(*) AS rows, CAST(max(length(line)) AS INTEGER) AS longest FROM lines "
                         "WHERE reason IS NOT NULL AND reason <> 'too many fields' GROUP BY 1",
    "filter_counts": _FILTER_COUNTS_SQL,
    "join_salted_merge": _JOIN_COUNTS_SQL,
    "join_salted_hash": _JOIN_COUNTS_SQL,
    "join_bucketed": _JOIN_COUNTS_SQL,
    "night_trip_counts_between": _NIGHT_BETWEEN_SQL,
    "csv_scan_inferred_stored": _TRIPS_2015_SQL,
    "text_lines_parse": _TEXT_PARSE_SQL,
    "text_report": _TEXT_REPORT_SQL,
}
