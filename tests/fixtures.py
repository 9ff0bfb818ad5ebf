"""Hand-written edge-case trips and zones (see FIXTURES.md section 3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from farepath.schemas import ZONE_LOOKUP

TRIP_COLUMNS = ("VendorID int, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
                "PULocationID int, DOLocationID int, pickup_longitude double, pickup_latitude double, "
                "dropoff_longitude double, dropoff_latitude double, fare_amount double, "
                "tip_amount double, airport_fee double, total_amount double")


def ts(h, m=0, s=0, day=15):
    return dt.datetime(2024, 1, day, h, m, s)


def zones(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "Manhattan", "Midtown", "Yellow Zone"),
        (2, "Manhattan", "Harlem", "Boro Zone"),
        (3, "Queens", "Astoria", "Boro Zone"),
        (4, "Queens", "Astoria", "Boro Zone"),      # shares a name with 3
        (5, "EWR", "Newark Airport", "EWR"),
        (6, None, None, None),                      # NULL zone and borough
        (7, "Brooklyn", "Park Slope", "Boro Zone"),
    ]
    return spark.createDataFrame(rows, ZONE_LOOKUP)


def trips(spark: SparkSession) -> DataFrame:
    P = (-73.98, 40.75)
    Q = (-73.90, 40.77)
    rows = [
        # vendor, pickup, dropoff, PU, DO, plon, plat, dlon, dlat, fare, tip, airport, total
        (1, ts(22, 59, 59), ts(23, 10), 1, 2, *P, *Q, 10.0, 1.0, None, 11.0),
        (1, ts(23, 0, 0), ts(23, 30), 1, 1, *P, *P, 5.0, 0.5, None, 5.5),
        (1, ts(6, 59, 59), ts(7, 5), 3, 4, *P, -73.70, 40.80, 7.0, 0.0, 1.75, 8.75),
        (1, ts(7, 0, 0), ts(6, 55), 3, 3, *P, -73.70, 40.80, 3.0, 0.0, None, 3.0),   # tie, -5 min
        (2, ts(12), ts(12, 20), 5, 1, 0.0, 40.7, *Q, 20.0, 2.0, None, 22.0),          # zero lon
        (2, ts(13), ts(13, 30), 1, 5, *P, None, 40.6, 30.0, 3.0, None, 33.0),         # NULL lon
        (2, ts(14), ts(14, 40), 99, 1, *P, -73.80, 40.60, 4.0, 0.0, None, 4.0),        # unknown PU
        (2, ts(15), ts(15, 10), 6, 6, *P, -73.95, 40.76, 2.0, 0.0, None, 2.0),         # NULL zone
        (None, ts(1), ts(1, 30), 7, 7, *P, -73.50, 40.90, 9.0, 1.0, None, 10.0),       # NULL vendor
        (3, ts(0, 30), ts(1), 7, 2, *P, *Q, 0.125, 0.0, None, 0.125),
    ]
    return spark.createDataFrame(rows, TRIP_COLUMNS)
