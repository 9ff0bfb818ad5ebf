"""Safe overwrites and the conversion of several files as one run."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from farepath import jobs
from farepath.records import read_record
from farepath.schemas import ZONE_LOOKUP
from farepath.sinks import IngestItem, conversions, convert_files, recover, write_csv, write_parquet, write_text
from farepath.sources import read_csv

ZONES = [(1, "Manhattan", "Midtown", "Yellow"), (2, "Queens", "Astoria", "Boro")]


def local(path: str) -> str:
    return path.removeprefix("file:")


def beside(path: str) -> list[str]:
    return [n for n in os.listdir(os.path.dirname(local(path))) if n.startswith("_")]


@pytest.mark.parametrize("write, read", [
    (write_csv, lambda s, p: read_csv(s, p, s.createDataFrame([], "id long").schema)), (write_parquet, lambda s, p: s.read.parquet(p)),
    (lambda df, p, **kw: write_text(df.select(F.col("id").cast("string").alias("value")), p, **kw), lambda s, p: s.read.text(p).select(F.col("value").cast("long"))),
])
def test_a_write_that_fails_midway_leaves_the_old_rows(spark, out_dir, write, read):
    path = f"{out_dir}/out"
    write(spark.range(5), path, mode="overwrite")
    half = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") > 900, F.raise_error(F.lit("midway")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="midway"):
        write(half, path, mode="overwrite")
    assert sorted(r[0] for r in read(spark, path).collect()) == list(range(5))
    assert beside(path) == []
    write(spark.range(3), path, mode="overwrite")
    assert sorted(r[0] for r in read(spark, path).collect()) == list(range(3))
    assert beside(path) == []


def test_an_output_can_be_rewritten_from_itself(spark, out_dir):
    path = write_parquet(spark.range(4), f"{out_dir}/self")
    write_parquet(spark.read.parquet(path).filter("id > 1"), path, mode="overwrite")
    assert spark.read.parquet(path).count() == 2


def test_a_swap_that_was_cut_off_is_ended(spark, out_dir):
    path = write_parquet(spark.range(4), f"{out_dir}/cut")
    os.rename(local(path), f"{local(out_dir)}/_previous-cut")  # between the renames
    recover(spark, path)
    assert spark.read.parquet(path).count() == 4 and beside(path) == []
    shutil.copytree(local(path), f"{local(out_dir)}/_previous-cut")  # after them
    write_parquet(spark.range(2), path, mode="overwrite")
    assert spark.read.parquet(path).count() == 2 and beside(path) == []


def sources(spark, out_dir):
    for name in ("a", "b"):
        write_csv(spark.createDataFrame(ZONES, ZONE_LOOKUP), f"{out_dir}/{name}-csv")
    return [IngestItem(f"{out_dir}/a-csv", f"{out_dir}/a", ZONE_LOOKUP), IngestItem(f"{out_dir}/b-csv", f"{out_dir}/b")]


def test_a_rerun_converts_only_what_changed(spark, out_dir):
    items, manifest = sources(spark, out_dir), f"{out_dir}/manifest"
    run = lambda some=items, **kw: [(d.status, d.rows) for d in convert_files(spark, some, manifest, **kw)]
    assert run() == [("converted", 2), ("converted", 2)]
    assert run() == [("unchanged", 2), ("unchanged", 2)]
    write_csv(spark.createDataFrame(ZONES * 2, ZONE_LOOKUP), items[1].source, mode="overwrite")
    assert run() == [("unchanged", 2), ("converted", 4)]
    shutil.rmtree(local(items[0].target))  # an output that is gone
    assert run() == [("converted", 2), ("unchanged", 4)]
    other_rule = [IngestItem(items[0].source, items[0].target), items[1]]
    assert run(other_rule) == [("converted", 2), ("unchanged", 4)]
    assert run(other_rule, again=True) == [("converted", 2), ("converted", 4)]
    record = read_record(spark, manifest, items[1].target)
    assert record["rows"] == 4 and record["columns"] == "struct<LocationID:int,Borough:string,Zone:string,service_zone:string>"


def test_a_file_that_fails_leaves_the_others(spark, out_dir):
    items = sources(spark, out_dir)
    manifest = f"{out_dir}/manifest"
    convert_files(spark, items, manifest)
    wrong = spark.createDataFrame([(1,)], "something int")
    write_csv(wrong, items[0].source, mode="overwrite")  # another header
    write_csv(spark.createDataFrame(ZONES * 3, ZONE_LOOKUP), items[1].source, mode="overwrite")
    done = convert_files(spark, [*items, IngestItem(f"{out_dir}/none", f"{out_dir}/c")], manifest)
    assert [d.status for d in done] == ["failed", "converted", "failed"] and "FileNotFoundError" in done[2].error
    assert spark.read.parquet(items[0].target).count() == 2  # as it was
    assert spark.read.parquet(items[1].target).count() == 6
    assert {(r["file"], r["rows"]) for r in conversions(spark, done).collect()} == {("b", 6)}
    assert convert_files(spark, items, manifest)[0].status == "failed"  # tried again
    assert conversions(spark, done[:1]).collect() == []
    with pytest.raises(ValueError):
        convert_files(spark, [items[0], items[0]], manifest)


def test_ingest_job_with_a_manifest(spark, out_dir, capsys):
    write_csv(spark.createDataFrame(ZONES, ZONE_LOOKUP), f"{out_dir}/zones.csv")
    args = ["ingest", "--zones", f"{out_dir}/zones.csv", "--out", f"{out_dir}/parquet", "--manifest", f"{out_dir}/manifest"]
    for status in ("converted", "unchanged"):
        assert jobs.main(args, spark) == 0
        assert capsys.readouterr().out.startswith(f"{status}: ")
    with pytest.raises(SystemExit):
        jobs.main([*args, "--trips", f"{out_dir}/none.csv"], spark)
    assert "failed: " in capsys.readouterr().out
