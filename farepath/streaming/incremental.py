"""Run an aggregating question over a growing folder of files.

``stream_files`` opens the folder as a streaming source with a fixed
schema. The question functions of :mod:`farepath.plans.trip_queries`
accept the streaming DataFrame as they accept a static one: the lookup
stays a static, size-checked broadcast side (stream-static join), and
the grouped counts become stateful aggregations whose state holds one
row per group (zone pair, borough, vendor), not per trip.

``run_available`` processes whatever is in the folder now, in as many
micro-batches as ``max_files_per_trigger`` makes, and leaves the latest
complete result as a Parquet table. The checkpoint and the table live in
the shared scratch folder, so a restarted query resumes from the last
committed batch, and a batch that is re-run after a lost executor
rewrites the same snapshot (overwrite is idempotent). A snapshot takes the
place of the last one when it is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from farepath.sinks.files import write_parquet
from farepath.session import named_scratch_path, new_scratch_path


def stream_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def run_available(result: DataFrame, output_path: str | None = None,
                  checkpoint_path: str | None = None) -> str:
    """Run a streaming aggregate over all data available now (complete
    output mode) and return the path of the Parquet snapshot. The state has
    the session's number of shuffle partitions, fixed at the first batch."""
    spark = result.sparkSession
    output_path = output_path or named_scratch_path(spark, "stream-out")
    checkpoint_path = checkpoint_path or new_scratch_path(spark, "stream-checkpoint")

    def write_snapshot(batch: DataFrame, batch_id: int) -> None:
        write_parquet(batch, output_path, mode="overwrite")

    query = (result.writeStream.outputMode("complete")
             .option("checkpointLocation", checkpoint_path)
             .foreachBatch(write_snapshot)
             .trigger(availableNow=True)
             .start())
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return output_path
