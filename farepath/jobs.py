"""Command-line jobs: read the inputs, answer one question, write the result.

    spark-submit --py-files farepath.zip farepath/jobs.py zone-pairs --trips T --zones Z --out O [--show 4]
    python -m farepath.jobs revenue --trips T.csv --zones Z.csv --format csv --out O

Trip and zone inputs are Parquet folders, or CSV files in the 2015 / 2024
trip layouts and the zone layout (``--format csv``). Results are written
as CSV with a header (overwrite); ``--single-file`` merges a small result
into one file;
``--show n`` also prints the first n rows. The join-strategy job prints
the physical plan and the joined row count instead of writing.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from farepath.plans import sql_queries as sq
from farepath.plans import trip_queries as tq
from farepath.plans.inspect import physical_plan
from farepath.schemas import BOROUGHS, TRIPS_2015, TRIPS_2024, ZONE_LOOKUP
from farepath.sinks import convert_files, ingest_csv_to_parquet, write_csv, write_text
from farepath.sinks.files import IngestItem
from farepath.sources import read_csv, read_csv_inferred, read_parquet

QUESTIONS = ("hour-means", "farthest-trip", "same-borough", "night-trips", "zone-pairs",
             "revenue", "join-strategy", "ingest")


def _read(spark: SparkSession, path: str, fmt: str, schema, inferred: bool = False) -> DataFrame:
    if fmt == "parquet":
        return read_parquet(spark, path)
    return read_csv_inferred(spark, path) if inferred else read_csv(spark, path, schema)


def build(spark: SparkSession, args) -> DataFrame | None:
    fmt = args.format
    q = args.question
    if q == "ingest":
        items = [IngestItem(src, f"{args.out.rstrip('/')}/{name}", schema)
                 for src, name, schema in (
                     (args.trips, "trips", TRIPS_2024), (args.trips_2015, "trips_2015", None),
                     (args.zones, "zones", None)) if src]
        if args.manifest:
            done = convert_files(spark, items, args.manifest)
            for d in done:
                print(f"{d.status}: {d.source} -> {d.target}" + (f", {d.rows} rows" if d.rows is not None else f", {d.error}"))
            if any(d.error for d in done):
                raise SystemExit(1)
        else:
            ingest_csv_to_parquet(spark, items, mode=args.mode)
        return None
    layout = TRIPS_2015 if q in ("hour-means", "farthest-trip") else TRIPS_2024
    trips = _read(spark, args.trips, fmt, layout, args.inferred) if args.trips else None
    zones = _read(spark, args.zones, fmt, ZONE_LOOKUP) if args.zones else None
    regions = args.boroughs or BOROUGHS
    if q == "hour-means":
        means = tq.hour_of_day_means(trips, use_udf=args.udf)
        return tq.hour_means_report(means) if args.report else means
    if q == "farthest-trip":
        if args.report:
            return tq.farthest_trip_report(tq.farthest_trip_one_per_vendor(trips, ordered=False))
        if args.one_per_vendor:
            return tq.farthest_trip_one_per_vendor(trips)
        return sq.farthest_trip_per_vendor_sql(spark, trips) if args.sql else tq.farthest_trip_per_vendor(trips)
    if q == "same-borough":
        return (sq.same_region_trip_counts_sql(spark, trips, zones, regions) if args.sql
                else tq.same_region_trip_counts(trips, zones, regions))
    if q == "night-trips":
        return sq.night_counts_sql(spark, trips) if args.sql else tq.night_counts(trips)
    if q == "zone-pairs":
        return tq.zone_pair_counts(trips, zones)
    if q == "revenue":
        return tq.region_revenue(trips, zones, regions)
    if q == "join-strategy":
        joined = tq.lookup_sample(trips, zones, n=args.sample, strategy=args.strategy)
        print(physical_plan(joined, "simple"))
        print(f"rows: {tq.joined_row_count(joined).first()[0]}")
        return None
    raise ValueError(q)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="farepath.jobs", description=__doc__.split("\n\n")[0])
    p.add_argument("question", choices=QUESTIONS)
    p.add_argument("--trips")
    p.add_argument("--trips-2015", help="ingest only: the 2015 trip file (inferred schema)")
    p.add_argument("--zones")
    p.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    p.add_argument("--out", help="output folder (CSV, or text for reports; for ingest, the Parquet root)")
    p.add_argument("--mode", default="overwrite", help="write mode (ingest: errorifexists to refuse reruns)")
    p.add_argument("--manifest", help="ingest: folder of records of finished files; only changed files are converted")
    p.add_argument("--show", type=int, default=0, help="print the first n rows")
    p.add_argument("--boroughs", nargs="*")
    p.add_argument("--sql", action="store_true", help="use the SQL form where there is one")
    p.add_argument("--inferred", action="store_true", help="infer the CSV trip schema from the data")
    p.add_argument("--single-file", action="store_true", help="merge a small result into one file")
    p.add_argument("--udf", action="store_true", help="hour-means: divide with a pandas UDF")
    p.add_argument("--one-per-vendor", action="store_true")
    p.add_argument("--report", action="store_true",
                   help="hour-means, farthest-trip: header and tab-separated lines as text")
    p.add_argument("--strategy", default="planner",
                   choices=("planner", "broadcast", "merge", "shuffle_hash"))
    p.add_argument("--sample", type=int, default=50, help="join-strategy: zones kept, by id")
    p.add_argument("--explain", choices=("simple", "extended", "formatted", "cost"),
                   help="print the plan of the result before running it")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"farepath-{args.question}").getOrCreate()
    result = build(spark, args)
    if result is not None:
        if args.explain:
            print(physical_plan(result, args.explain))
        if args.show:
            result.show(args.show, truncate=False)
        if args.out and args.report:
            write_text(result, args.out, mode=args.mode, single_file=args.single_file)
        elif args.out:
            write_csv(result, args.out, mode=args.mode, single_file=args.single_file)
    return 0


if __name__ == "__main__":
    sys.exit(main())
