"""Writers: CSV, Parquet, text, and CSV-to-Parquet conversion."""

from farepath.sinks.commit import recover, replace_folder
from farepath.sinks.convert import Conversion, conversions, convert_files
from farepath.sinks.files import IngestItem, ingest_csv_to_parquet, write_csv, write_parquet, write_text
from farepath.sinks.layout import read_between, write_bucketed, write_by_period

__all__ = ["Conversion", "IngestItem", "conversions", "convert_files", "ingest_csv_to_parquet", "read_between", "recover", "replace_folder",
           "write_bucketed", "write_by_period", "write_csv", "write_parquet", "write_text"]
