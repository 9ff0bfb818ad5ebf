"""Conversion of several CSV files as one run.

Every file is a job of its own, some of them at the same time. A finished one
leaves a record in the manifest: the signature of its source (names, lengths
and times of its files), its rows and columns. A later run converts only files
whose source has changed, whose schema rule has, or whose output is gone. A
file that fails is reported and leaves the others, and its own old output, as
they are.

Rows are counted while they are written (an observed metric), not in a pass of
their own. What the driver holds is a record per file and the sources'
listings.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from farepath.records import read_record, source_signature, write_record
from farepath.session import file_system
from farepath.sinks.files import IngestItem, write_parquet
from farepath.sources.files import read_csv, read_csv_inferred

CONVERTED, UNCHANGED, FAILED = "converted", "unchanged", "failed"


@dataclass(frozen=True)
class Conversion:
    """What became of one file."""

    source: str
    target: str
    status: str
    rows: int | None = None
    columns: str | None = None  # names and types, as Spark writes a struct
    error: str | None = None


def _convert(spark: SparkSession, item: IngestItem, manifest: str, again: bool) -> Conversion:
    rule = item.schema.json() if item.schema is not None else "inferred"
    try:
        signature = source_signature(spark, item.source)
        if signature is None:
            raise FileNotFoundError(f"no file at {item.source}")
        known = read_record(spark, manifest, item.target)
        fs, finished = file_system(spark, f"{item.target}/_SUCCESS")
        if known and not again and (known["signature"], known["rule"]) == (signature, rule) and fs.exists(finished):
            return Conversion(item.source, item.target, UNCHANGED, known["rows"], known["columns"])
        read = read_csv(spark, item.source, item.schema) if item.schema is not None else read_csv_inferred(spark, item.source)
        counted = Observation()
        write_parquet(read.observe(counted, F.count(F.lit(1)).alias("rows")), item.target, mode="overwrite")
        done = Conversion(item.source, item.target, CONVERTED, counted.get["rows"], read.schema.simpleString())
        write_record(spark, manifest, item.target, {"signature": signature, "rule": rule, **asdict(done)})
        return done
    except Exception as error:  # of this file; the others go on
        return Conversion(item.source, item.target, FAILED, error=f"{type(error).__name__}: {str(error)[:500]}")


def convert_files(spark: SparkSession, items: Sequence[IngestItem], manifest: str, at_once: int = 3,
                  again: bool = False) -> list[Conversion]:
    """Convert each item, ``at_once`` jobs at a time, and say what became of
    it, in order of the items. ``again`` converts unchanged files too."""
    targets = [item.target.rstrip("/") for item in items]
    if len(set(targets)) < len(targets):
        raise ValueError("two files have one target")
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return list(pool.map(lambda item: _convert(spark, item, manifest, again), items))


def conversions(spark: SparkSession, done: Sequence[Conversion]) -> DataFrame:
    """A row per column of each converted file, read from the outputs: file
    (the output's name), rows, place, column, type."""
    parts = []
    for one in done:
        if one.status == FAILED:
            continue
        table = spark.read.parquet(one.target)
        columns = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"))
                            for i, f in enumerate(table.schema.fields)])
        parts.append(table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(one.target.rstrip("/").rpartition("/")[2]).alias("file"), "rows", F.inline(columns)))
    if not parts:
        return spark.createDataFrame([], "file string, rows long, place int, column string, type string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
