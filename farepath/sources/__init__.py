"""Readers: CSV (fixed, inferred or checked schema), Parquet, text lines, and
the adapters that derive trip and zone tables from the driver's tables."""

from farepath.sources.files import read_csv, read_csv_inferred, read_csv_inferred_once, read_parquet
from farepath.sources.refused import accepted, counts_by_reason, parse_delimited_checked, read_csv_checked, refused
from farepath.sources.text import drop_header, parse_delimited, read_delimited, read_lines

__all__ = [
    "accepted",
    "counts_by_reason",
    "drop_header",
    "parse_delimited",
    "parse_delimited_checked",
    "read_csv",
    "read_csv_checked",
    "read_csv_inferred",
    "read_csv_inferred_once",
    "read_delimited",
    "read_lines",
    "read_parquet",
    "refused",
]
