"""Great-circle distance as a native column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from farepath.functions._cols import ColumnOrName, as_col

# Fixed value: earth radius in km used for trip distances.
EARTH_RADIUS_KM = 6378.0


def haversine_km(lon1: ColumnOrName, lat1: ColumnOrName,
                 lon2: ColumnOrName, lat2: ColumnOrName,
                 radius_km: float = EARTH_RADIUS_KM) -> Column:
    """Haversine distance between (lon1, lat1) and (lon2, lat2), degrees in,
    km out.

    The squared half-chord ``a`` is clamped into [0, 1]: rounding can push
    it just past either end (antipodal points, latitudes out of range), and
    ``sqrt`` of a negative would give NaN, which sorts above every distance.
    The clamp is a CASE so that a NULL input stays NULL; a NaN or infinite
    coordinate gives NaN (to Spark, NaN is above 1, so it is let through
    first).
    """
    p1, p2 = F.radians(as_col(lat1)), F.radians(as_col(lat2))
    half_dlat = (p2 - p1) / 2
    half_dlon = (F.radians(as_col(lon2)) - F.radians(as_col(lon1))) / 2
    sin_lat, sin_lon = F.sin(half_dlat), F.sin(half_dlon)
    a = sin_lat * sin_lat + F.cos(p1) * F.cos(p2) * sin_lon * sin_lon
    a = F.when(F.isnan(a), a).when(a < 0, F.lit(0.0)).when(a > 1, F.lit(1.0)).otherwise(a)
    return F.lit(float(radius_km)) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
