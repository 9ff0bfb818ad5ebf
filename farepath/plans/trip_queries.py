"""The trip questions, DataFrame form.

Each function takes DataFrames and column names and returns a DataFrame.
Most are lazy; building one that may broadcast a lookup first counts the
lookup's needed columns, and the arg-max questions first compute and
checkpoint the per-group maxima. Defaults are the trip-file column names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farepath.functions import (
    EARTH_RADIUS_KM,
    all_finite,
    all_nonzero,
    duration_minutes,
    fixed_decimals,
    haversine_km,
    hour_from_text,
    hour_of_day,
    in_hour_window,
    money,
)
from farepath.operators import (
    FilterObserver,
    group_counts,
    group_means,
    group_means_udf,
    group_money_sums,
    one_row_per_group_max,
    rows_at_group_max,
    sample_lookup_join,
    text_report,
    top_k,
    with_lookup,
)
from farepath.operators.lookup import DEFAULT_MAX_BROADCAST_ROWS, join_roles
from farepath.operators.observed import filtered
from farepath.operators.skew import salted_lookup_join
from farepath.schemas import BOROUGHS, REVENUE_MEASURES

PICKUP_COORDS = ("pickup_longitude", "pickup_latitude")
DROPOFF_COORDS = ("dropoff_longitude", "dropoff_latitude")
PICKUP_TIME = "tpep_pickup_datetime"
DROPOFF_TIME = "tpep_dropoff_datetime"

# Output column names of the trip questions.
HOUR = "HourofDay"
MAX_DISTANCE = "Max Haversine Distance (km)"
DURATION = "Duration (min)"
TOTAL_TRIPS = "TotalTrips"
NIGHT_TRIPS = "NightTrips"
PICKUP_ZONE = "Pickup Zone"
DROPOFF_ZONE = "Dropoff Zone"


def _hour(df: DataFrame, time_col: str):
    """Hour of a timestamp column, or of ``yyyy-MM-dd HH...`` text."""
    return hour_from_text(time_col) if dict(df.dtypes)[time_col] == "string" else hour_of_day(time_col)


def _round(c, decimals):
    return F.round(c, decimals) if decimals is not None else c


# C1 -------------------------------------------------------------------------

def hour_of_day_means(df: DataFrame, time_col: str = PICKUP_TIME,
                      measures: Mapping[str, str] | None = None,
                      nonzero: Sequence[str] | None = None,
                      decimals: int | None = None, use_udf: bool = False,
                      observer: FilterObserver | None = None) -> DataFrame:
    """Mean of each measure per hour of day, rows with a zero or NULL in
    ``nonzero`` left out, ordered by hour. ``use_udf`` builds the means from
    sums and counts with a vectorised Python division instead of ``avg``.
    A text ``time_col`` (lines parsed without a timestamp type) gives its
    hour from the two characters after the date. ``observer`` counts what the
    filter keeps and drops."""
    measures = dict(measures or {"pickup_longitude": "Longitude", "pickup_latitude": "Latitude"})
    nonzero = list(nonzero if nonzero is not None else measures)
    hours = (filtered(df, all_nonzero(*nonzero), observer)
             .select(_hour(df, time_col).alias(HOUR), *measures))
    agg = (group_means_udf(hours, HOUR, measures) if use_udf
           else group_means(hours, HOUR, measures))
    return agg.select(HOUR, *[_round(F.col(c), decimals).alias(c) for c in measures.values()]) \
        .orderBy(HOUR)


def hour_means_report(means: DataFrame, decimals: int = 6) -> DataFrame:
    """Hour means as text lines under a header, hour order. Means are
    written with ``decimals`` fixed decimals (Java's and Python's shortest
    float text differ in places, fixed decimals do not)."""
    # Header text and separator of the hour report.
    measures = [c for c in means.columns if c != HOUR]
    header = "\t\t".join(["HourOfDay", *measures])
    line = [F.col(HOUR), *[fixed_decimals(F.round(m, decimals), decimals) for m in measures]]
    return text_report(means, header, line, "\t\t", order=[HOUR])


# C2 -------------------------------------------------------------------------

def with_distance_duration(trips: DataFrame, vendor: str = "VendorID",
                           pickup: Sequence[str] = PICKUP_COORDS,
                           dropoff: Sequence[str] = DROPOFF_COORDS,
                           pickup_time: str = PICKUP_TIME, dropoff_time: str = DROPOFF_TIME,
                           radius_km: float = EARTH_RADIUS_KM, observer: FilterObserver | None = None) -> DataFrame:
    """Trips with all four coordinates non-zero, finite and non-NULL, with
    ``distance_km`` and ``duration_min``. ``observer`` counts what the filter
    keeps and drops."""
    return (filtered(trips, all_nonzero(*pickup, *dropoff) & all_finite(*pickup, *dropoff), observer)
            .select(vendor, *pickup, *dropoff, pickup_time, dropoff_time,
                    haversine_km(pickup[0], pickup[1], dropoff[0], dropoff[1], radius_km)
                    .alias("distance_km"),
                    duration_minutes(pickup_time, dropoff_time).alias("duration_min")))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows round-robin before a global sort. The sort samples its
    input in a job of its own, which then reads this small exchange instead
    of the trips once more; however many rows tie, no task gets them all."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def farthest_trip_per_vendor(trips: DataFrame, vendor: str = "VendorID",
                             max_groups: int = DEFAULT_MAX_BROADCAST_ROWS, **kw) -> DataFrame:
    """Per vendor, every trip of greatest great-circle distance (ties kept),
    with its duration; distance rounded to 2 decimals, minutes to 1."""
    dd = with_distance_duration(trips, vendor=vendor, **kw).select(vendor, "distance_km", "duration_min")
    top = rows_at_group_max(dd, [vendor], "distance_km", max_groups)
    out = top.select(vendor, F.round("distance_km", 2).alias(MAX_DISTANCE),
                     F.round("duration_min", 1).alias(DURATION))
    return spread(out).orderBy(vendor, DURATION)


def farthest_trip_one_per_vendor(trips: DataFrame, vendor: str = "VendorID",
                                 max_groups: int = DEFAULT_MAX_BROADCAST_ROWS,
                                 ordered: bool = True, **kw) -> DataFrame:
    """One trip per vendor at the greatest distance; among tied trips the
    shortest duration wins. ``ordered=False`` skips the final sort when the
    caller sorts anyway (the text report)."""
    dd = with_distance_duration(trips, vendor=vendor, **kw).select(vendor, "distance_km", "duration_min")
    return farthest_one_of(dd, vendor, max_groups, ordered)


def farthest_one_of(dd: DataFrame, vendor: str = "VendorID",
                    max_groups: int = DEFAULT_MAX_BROADCAST_ROWS, ordered: bool = True) -> DataFrame:
    """:func:`farthest_trip_one_per_vendor` from rows that already have
    ``distance_km`` and ``duration_min``."""
    one = one_row_per_group_max(dd, [vendor], "distance_km", payload=["duration_min"],
                                tie_break=[F.col("duration_min")], max_groups=max_groups)
    out = one.select(vendor, F.round("distance_km", 2).alias(MAX_DISTANCE),
                     F.round("duration_min", 1).alias(DURATION))
    return out.orderBy(vendor) if ordered else out


def farthest_trip_report(farthest: DataFrame, vendor: str = "VendorID") -> DataFrame:
    """The one-per-vendor result as tab-separated text lines under a header."""
    # Header text and separators of the distance report.
    header = "VendorID\tMax Haversine Distance (km)\tDuration (min)"
    sep = "\t\t\t"
    line = [F.col(vendor), fixed_decimals(MAX_DISTANCE, 2), fixed_decimals(DURATION, 1)]
    return text_report(farthest, header, line, sep, order=[vendor])


# C3 -------------------------------------------------------------------------

def same_region_trip_counts(trips: DataFrame, lookup: DataFrame,
                            regions: Sequence[str] = BOROUGHS,
                            pickup_key: str = "PULocationID", dropoff_key: str = "DOLocationID",
                            region_col: str = "Borough", strategy: str = "auto") -> DataFrame:
    """Trips starting and ending in the same listed borough, per borough,
    busiest first. Trips are counted per zone-id pair first (see
    :func:`_id_pair_counts`); only those counts meet the lookup."""
    regions = list(regions)
    kept = lookup.where(F.col(region_col).isin(regions))
    both = join_roles(_id_pair_counts(trips, pickup_key, dropoff_key), kept,
                      [(pickup_key, {region_col: "__pu"}), (dropoff_key, {region_col: "__do"})],
                      strategy=strategy)
    same = both.where(F.col("__pu") == F.col("__do"))
    return (same.groupBy(F.col("__pu").alias(region_col)).agg(F.sum("__n").alias(TOTAL_TRIPS))
            .orderBy(F.desc(TOTAL_TRIPS), F.col(region_col)))


def _id_pair_counts(trips: DataFrame, pickup_key: str, dropoff_key: str) -> DataFrame:
    """Trips per (pickup id, drop-off id), column ``__n``.

    Aggregating before the lookup joins (Catalyst does not move an
    aggregate below a join by itself) keeps the per-trip work to a partial
    count on two ints in every task; the joins then see at most zones^2
    rows instead of every trip. Inner-join semantics carry over: a pair
    whose id is unknown or NULL finds no zone and drops, a zone id listed
    twice multiplies the count, and ids that share a name merge in the
    final re-aggregation by name."""
    if trips.isStreaming:
        # A streaming query allows one stateful aggregation: every trip
        # counts 1 and the count happens after the joins, in the state.
        return trips.select(pickup_key, dropoff_key, F.lit(1).cast("long").alias("__n"))
    return group_counts(trips.select(pickup_key, dropoff_key), [pickup_key, dropoff_key], "__n")


# C4 -------------------------------------------------------------------------

def night_counts(df: DataFrame, time_col: str = PICKUP_TIME, key: str = "VendorID",
                 start_hour: int = 23, end_hour: int = 7,
                 name: str = NIGHT_TRIPS) -> DataFrame:
    """Rows whose hour lies in [start_hour, end_hour) (wrapping midnight),
    per key, ordered by key. A NULL key is its own group; a NULL or
    unreadable time drops."""
    night = df.select(key, time_col).where(in_hour_window(_hour(df, time_col), start_hour, end_hour))
    return group_counts(night, key, name).orderBy(key)


# C5 -------------------------------------------------------------------------

def zone_pair_counts(trips: DataFrame, lookup: DataFrame,
                     pickup_key: str = "PULocationID", dropoff_key: str = "DOLocationID",
                     zone_col: str = "Zone", strategy: str = "auto") -> DataFrame:
    """Trips per ordered pair of different zones (by zone name), busiest
    first. Counted per id pair first, then named and re-counted by name."""
    both = join_roles(_id_pair_counts(trips, pickup_key, dropoff_key), lookup,
                      [(pickup_key, {zone_col: PICKUP_ZONE}), (dropoff_key, {zone_col: DROPOFF_ZONE})],
                      strategy=strategy)
    pairs = both.where(F.col(PICKUP_ZONE) != F.col(DROPOFF_ZONE))
    return (pairs.groupBy(PICKUP_ZONE, DROPOFF_ZONE).agg(F.sum("__n").alias(TOTAL_TRIPS))
            .orderBy(F.desc(TOTAL_TRIPS), PICKUP_ZONE, DROPOFF_ZONE))


def zone_pair_top(trips: DataFrame, lookup: DataFrame, k: int = 4, **kw) -> DataFrame:
    """The ``k`` busiest zone pairs; equal counts ordered by zone names."""
    counts = zone_pair_counts(trips, lookup, **kw)
    return top_k(counts, k, [F.desc(TOTAL_TRIPS), F.col(PICKUP_ZONE), F.col(DROPOFF_ZONE)])


# C6 -------------------------------------------------------------------------

def region_revenue(trips: DataFrame, lookup: DataFrame,
                   regions: Sequence[str] = BOROUGHS,
                   measures: Mapping[str, str] = REVENUE_MEASURES,
                   order_measure: str = "total_amount",
                   pickup_key: str = "PULocationID", region_col: str = "Borough",
                   exact_cents: bool = True, strategy: str = "auto") -> DataFrame:
    """Sum of each revenue column per pickup borough, formatted as money,
    ordered by the numeric sum of ``order_measure`` (largest first)."""
    measures = dict(measures)
    if order_measure not in measures:
        raise ValueError(f"order_measure {order_measure!r} is not one of the measures {list(measures)}")
    kept = lookup.where(F.col(region_col).isin(list(regions)))
    sums_of = {m: f"__sum_{m}" for m in measures}
    rest_of = {m: f"__rest_{m}" for m in measures} if exact_cents else {}
    if trips.isStreaming:  # one stateful aggregation: join, then sum
        joined = with_lookup(trips.select(pickup_key, *measures), kept, pickup_key,
                             {region_col: region_col}, strategy=strategy)
        sums = group_money_sums(joined, region_col, sums_of, exact_cents=exact_cents, inexact=rest_of)
    else:
        # Sum per pickup zone id first (ints, partial sums in every task),
        # then name the zones and add the per-zone sums up per borough.
        per_zone = group_money_sums(trips.select(pickup_key, *measures), pickup_key, sums_of,
                                    exact_cents=exact_cents, inexact=rest_of)
        joined = with_lookup(per_zone, kept, pickup_key, {region_col: region_col}, strategy=strategy)
        sums = joined.groupBy(region_col).agg(
            *[F.sum(c).alias(c) for c in [*sums_of.values(), *rest_of.values()]])

    def total(m):
        """The exact sum; with NaN, infinite or huge amounts a double sum."""
        exact = F.col(sums_of[m])
        if m not in rest_of:
            return exact, money(exact)
        rest = F.col(rest_of[m])
        rough = rest + F.coalesce(exact.cast("double"), F.lit(0.0))
        text = F.when(all_finite(rough), money(rough)).otherwise(rough.cast("string"))
        return rough, F.when(rest.isNull(), money(exact)).otherwise(text)

    rough, _ = total(order_measure)
    order = [F.desc(rough), F.desc(sums_of[order_measure])] if rest_of else [F.desc(sums_of[order_measure])]
    return (sums.orderBy(*order, F.col(region_col))
            .select(region_col, *[total(m)[1].alias(label) for m, label in measures.items()]))


# C8 -------------------------------------------------------------------------

def lookup_join_counts(trips: DataFrame, lookup: DataFrame, strategy: str,
                       fact_key: str = "PULocationID", lookup_key: str = "LocationID",
                       zone_col: str = "Zone") -> DataFrame:
    """Fact-to-lookup join under a chosen strategy ("auto", "broadcast",
    "merge", "shuffle_hash", "planner"), counted per zone. Trips are counted
    per zone id first, so the join, whichever it is, meets one row per id
    and task and no id is hot."""
    per_id = group_counts(trips.select(fact_key), fact_key, "__n")
    joined = with_lookup(per_id, lookup, fact_key,
                         {lookup_key: lookup_key, zone_col: zone_col},
                         lookup_key=lookup_key, strategy=strategy)
    return joined.groupBy(lookup_key, zone_col).agg(F.sum("__n").alias("trips"))


def salted_join_counts(trips: DataFrame, lookup: DataFrame, strategy: str = "merge", fact_key: str = "PULocationID",
                       lookup_key: str = "LocationID", zone_col: str = "Zone", tasks: int | None = None) -> DataFrame:
    """The counts of :func:`lookup_join_counts` by joining every trip, under a
    strategy that shuffles them; hot zones are salted."""
    joined = salted_lookup_join(trips.select(fact_key), lookup, fact_key, {lookup_key: lookup_key, zone_col: zone_col}, lookup_key, strategy, tasks)
    return group_counts(joined, [lookup_key, zone_col], "trips")


def bucketed_join_counts(spark: SparkSession, trips_table: str, zones_table: str, fact_key: str = "PULocationID",
                         lookup_key: str = "LocationID", zone_col: str = "Zone") -> DataFrame:
    """The same counts by joining every trip of a table bucketed by its zone id
    to zones bucketed alike: a merge join and a count without a shuffle."""
    trips, zones = (spark.table(t).alias(a) for t, a in ((trips_table, "t"), (zones_table, "z")))
    joined = trips.join(zones.hint("merge"), F.col(f"t.{fact_key}") == F.col(f"z.{lookup_key}"))
    return group_counts(joined.select(lookup_key, zone_col), [lookup_key, zone_col], "trips")


def joined_row_count(joined: DataFrame, name: str = "rows") -> DataFrame:
    """Size of a join result as a one-row DataFrame (a global count: one
    partial count per task, one final row)."""
    return joined.agg(F.count(F.lit(1)).alias(name))


def lookup_sample(trips: DataFrame, lookup: DataFrame, n: int = 50,
                  fact_key: str = "PULocationID", lookup_key: str = "LocationID",
                  strategy: str = "planner") -> DataFrame:
    """Trips joined to the first ``n`` zones by id, all columns of both."""
    return sample_lookup_join(trips, lookup, fact_key, n, lookup_key, strategy)


def lookup_sample_count(trips: DataFrame, lookup: DataFrame, n: int = 50,
                        fact_key: str = "PULocationID", lookup_key: str = "LocationID",
                        strategy: str = "planner", name: str = "rows") -> DataFrame:
    """Rows of :func:`lookup_sample`, from trips counted per zone id before
    the join."""
    per_id = group_counts(trips.select(fact_key), fact_key, "__n")
    joined = sample_lookup_join(per_id, lookup.select(lookup_key), fact_key, n, lookup_key, strategy)
    return joined.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias(name))
