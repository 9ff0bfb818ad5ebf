"""Time expressions: parse, hour of day, duration, wrap-around hour window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from farepath.functions._cols import ColumnOrName, as_col

# Fixed value: timestamp text layout of the trip files.
TRIP_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


# Layouts that a plain cast to TIMESTAMP_NTZ reads, and the shape a text
# must have: the cast alone would also take a year, a date or an offset.
_SECONDS = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
_CASTABLE = {TRIP_TIME_FORMAT: _SECONDS + "$", "yyyy-MM-dd HH:mm:ss[.SSSSSS]": _SECONDS + r"(\.\d{6})?$",
             "yyyy-MM-dd HH:mm:ss.SSSSSS": _SECONDS + r"\.\d{6}$"}


def parse_timestamp(c: ColumnOrName, fmt: str | None = TRIP_TIME_FORMAT) -> Column:
    """Text to TIMESTAMP_NTZ; text that isn't in the layout becomes NULL
    instead of failing, as in the CSV reader.

    The ISO-like trip layouts are checked for their shape and read with
    ``try_cast``, which involves no time zone (a wall time inside a
    daylight-saving gap stays as written). ``None`` takes whatever the cast
    takes. Other layouts go through ``try_to_timestamp`` in the session
    zone."""
    if fmt is None:
        return as_col(c).try_cast("timestamp_ntz")
    if fmt in _CASTABLE:
        text = as_col(c)
        return F.when(text.rlike(_CASTABLE[fmt]), text.try_cast("timestamp_ntz"))
    return F.try_to_timestamp(as_col(c), F.lit(fmt)).cast("timestamp_ntz")


def hour_of_day(c: ColumnOrName) -> Column:
    """Hour 0..23 as INT."""
    return F.hour(as_col(c))


def hour_from_text(c: ColumnOrName) -> Column:
    """Hour from the two characters after the date of a
    ``yyyy-MM-dd HH...`` text, as INT; NULL when they are not an hour of
    0 to 23. Cheaper than parsing the whole timestamp when only the hour is
    needed."""
    hour = F.substring(as_col(c), 12, 2)
    return F.when(hour.rlike(r"^([01]\d|2[0-3])$"), hour.try_cast("int"))


def duration_minutes(start: ColumnOrName, end: ColumnOrName) -> Column:
    """(end - start) in whole epoch seconds, divided by 60 (DOUBLE).

    Negative when end precedes start. Each side is truncated to whole
    seconds first, as a cast to long would do; unlike that cast this also
    accepts TIMESTAMP_NTZ, for which no time zone is involved. For zoned
    TIMESTAMP it is the true elapsed time across daylight-saving changes."""
    return (F.unix_timestamp(as_col(end)) - F.unix_timestamp(as_col(start))) / F.lit(60.0)


def in_hour_window(hour: ColumnOrName, start_hour: int, end_hour: int) -> Column:
    """Hour in [start_hour, end_hour), wrapping past midnight when
    start_hour > end_hour (23 to 7 is 23, 0, ..., 6). NULL drops."""
    h = as_col(hour)
    if start_hour > end_hour:
        return (h >= start_hour) | (h < end_hour)
    return (h >= start_hour) & (h < end_hour)
