"""Input schemas of the trip and zone files.

Fixed values: column names, order and types as the trip files declare
them. Trip times are TIMESTAMP_NTZ so that hour-of-day does not depend
on the session time zone.
"""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _schema(fields):
    return StructType([StructField(name, dtype(), True) for name, dtype in fields])


# The 2015 trip layout, 19 columns, in file order.
TRIPS_2015 = _schema([
    ("VendorID", IntegerType),
    ("tpep_pickup_datetime", TimestampNTZType),
    ("tpep_dropoff_datetime", TimestampNTZType),
    ("passenger_count", IntegerType),
    ("trip_distance", DoubleType),
    ("pickup_longitude", DoubleType),
    ("pickup_latitude", DoubleType),
    ("RateCodeID", IntegerType),
    ("store_and_fwd_flag", StringType),
    ("dropoff_longitude", DoubleType),
    ("dropoff_latitude", DoubleType),
    ("payment_type", IntegerType),
    ("fare_amount", DoubleType),
    ("extra", DoubleType),
    ("mta_tax", DoubleType),
    ("tip_amount", DoubleType),
    ("tolls_amount", DoubleType),
    ("improvement_surcharge", DoubleType),
    ("total_amount", DoubleType),
])

# The 2024 trip layout, 20 columns, in file order.
TRIPS_2024 = _schema([
    ("VendorID", IntegerType),
    ("tpep_pickup_datetime", TimestampNTZType),
    ("tpep_dropoff_datetime", TimestampNTZType),
    ("passenger_count", IntegerType),
    ("trip_distance", DoubleType),
    ("RatecodeID", IntegerType),
    ("store_and_fwd_flag", StringType),
    ("PULocationID", IntegerType),
    ("DOLocationID", IntegerType),
    ("payment_type", IntegerType),
    ("fare_amount", DoubleType),
    ("extra", DoubleType),
    ("mta_tax", DoubleType),
    ("tip_amount", DoubleType),
    ("tolls_amount", DoubleType),
    ("improvement_surcharge", DoubleType),
    ("total_amount", DoubleType),
    ("congestion_surcharge", DoubleType),
    ("airport_fee", DoubleType),
    ("cbd_congestion_fee", DoubleType),
])

# The zone lookup layout, 4 columns, in file order.
ZONE_LOOKUP = _schema([
    ("LocationID", IntegerType),
    ("Borough", StringType),
    ("Zone", StringType),
    ("service_zone", StringType),
])

# The five boroughs the borough questions keep.
BOROUGHS = ["Manhattan", "Queens", "Brooklyn", "Bronx", "Staten Island"]

# The eight revenue columns summed per borough, with the
# labels of the formatted report, in report order.
REVENUE_MEASURES = {
    "fare_amount": "Fare ($)",
    "tip_amount": "Tips ($)",
    "tolls_amount": "Tolls ($)",
    "extra": "Extras ($)",
    "mta_tax": "MTA Tax ($)",
    "congestion_surcharge": "Congestion ($)",
    "airport_fee": "Airport Fee ($)",
    "total_amount": "Total Revenue ($)",
}
