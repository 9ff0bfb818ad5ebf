"""Exact deduplication with a stateful stream.

Documents are read as a stream, once. A first, stateless query normalises and
hashes each new row into a narrow table of places: id, locator of its content
(file and row) and digest. A second one keeps, per digest, keyed state: the
stable identifier of the row that stays (the smallest document id), its
locator and the number of rows. The state is RocksDB's, on disk with its
changes in the checkpoint folder; it has no watermark and nothing expires. A
later run on the same checkpoint folder reads only new files and adds them to
the same state; the row that stays may then be in an earlier file.

A hit on a digest is no proof: rows of digests with more than one row are
compared byte by byte with the row that stays, wherever it is. Where some
differ (a digest collision), all rows of the digest, those of earlier files
too, are grouped once more by the text itself.

*Hot digests.* The rows of a digest with more than a piece of the average
task's rows meet its one state row in a broadcast join (there can be only
``PIECES`` of them a task, a proven bound), and their texts meet the text that
stays in as many salts as they have pieces.

Only DataFrame and SQL functions are used.

Edge cases: a NULL text counts as empty; a NULL id comes after all others;
rows with equal text and id are told apart by their place in the table, one
is kept; an empty table gives no rows. Files of earlier runs must still be
there to be compared with; if one is gone, the read fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farepath.llm.common import text_of, written
from farepath.session import new_scratch_path

SPACES = r"[\x20\x09-\x0D]+"
#: State on disk; without room set aside for each partition's log files.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bytes of new files that one micro-batch reads.
BATCH_BYTES = 64 << 30
#: Pieces in which an average task's rows would come; a digest with more rows
#: than a piece is hot.
PIECES = 8
_PLACES = "id long, at struct<file:string,row:long>, digest string, text_sha256 string"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rows(frame: DataFrame, id_column: str, text_column: str, digest) -> DataFrame:
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = frame.select(F.col(id_column).cast("long").alias("id"), at.alias("at"), normalised(text_of(text_column)).alias("text"))
    return rows.withColumn("digest", digest(F.col("text")))


def _order() -> Column:
    """Rows in order of id, NULL last, then of place."""
    return F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("at").alias("at"))


def update_state(spark: SparkSession, path: str, checkpoint: str, id_column: str = "doc_id", text_column: str = "text",
                 digest=sha256_hex, batch_bytes: int = BATCH_BYTES) -> None:
    """Read the files under ``path`` that the stream hasn't seen, add their
    rows to the places and to the state under ``checkpoint``."""
    own = spark.newSession()  # the state's settings are no one else's
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for name, value in STATE_SETTINGS.items():
        own.conf.set(name, value)
    schema = spark.read.parquet(path).schema
    head, _, last = path.rstrip("/").rpartition("/")
    stream = (own.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes)
              .parquet(f"{head}/{last[:-1]}[{last[-1]}]"))  # a pattern: the table may be one file or a folder
    rows = _rows(stream, id_column, text_column, digest).withColumn("text_sha256", sha256_hex(F.col("text")))
    if digest is sha256_hex:
        rows = rows.withColumn("digest", F.col("text_sha256"))
    _to_end(rows.select("id", "at", "digest", "text_sha256").writeStream.format("parquet").option("path", f"{checkpoint}/places"), f"{checkpoint}/places-log")
    state = (own.readStream.schema(_PLACES).parquet(f"{checkpoint}/places").groupBy("digest")
             .agg(F.min(_order()).alias("stays"), F.count("*").alias("n")))
    _to_end(state.writeStream.outputMode("update").format("noop"), f"{checkpoint}/state")


def _to_end(writer, log: str) -> None:
    writer.option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``digest``, ``stays`` (no_id, id, at), ``n`` from the keyed state."""
    state = spark.read.format("statestore").load(f"{checkpoint}/state")
    return state.select(F.col("key.digest").alias("digest"), F.col("value")["min"].alias("stays"), F.col("value")["count"].alias("n"))


def read_places(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``id``, ``at``, ``digest``, ``text_sha256`` of every row of every run."""
    return spark.read.schema(_PLACES).parquet(f"{checkpoint}/places")


def _texts_in(frame: DataFrame, text_column: str) -> DataFrame:
    """``of`` (the place) and the normalised ``text`` of each row."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return frame.select(place.alias("of"), normalised(text_of(text_column)).alias("text"))


def _files(places: DataFrame) -> list[str]:
    """Names of the files that hold the places."""
    return [r[0] for r in places.select("at.file").distinct().collect()]


def dedup(spark: SparkSession, path: str, id_column: str = "doc_id", text_column: str = "text", checkpoint: str | None = None,
          digest=sha256_hex, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of the Parquet table: ``doc_id``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``, ``at`` and ``keep_at`` (file
    and row of the row and of the one that stays). With a ``checkpoint`` of
    earlier runs, ids and sizes are those over all files seen by it."""
    fresh = checkpoint is None
    checkpoint = checkpoint or new_scratch_path(spark, "dedup-state")
    update_state(spark, path, checkpoint, id_column, text_column, digest, batch_bytes)
    places, state = read_places(spark, checkpoint), written(read_state(spark, checkpoint), "dedup-groups")
    table = spark.read.parquet(path)
    mine = places
    if not fresh:  # the rows of this table's files
        files = table.select(F.col("_metadata.file_path").alias("name")).distinct()
        mine = places.join(files, places["at.file"] == files["name"], "left_semi")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = state.agg(F.sum("n")).first()[0] or 0
    piece = max(1, -(-total // (tasks * PIECES)))
    hot = state.filter(F.col("n") > piece).select(F.col("digest").alias("hot_digest"), "stays", "n")  # at most tasks * PIECES rows
    met = mine.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left").drop("hot_digest")
    cold = met.filter("n IS NULL").drop("stays", "n").join(state.filter(F.col("n") <= piece), "digest")
    classed = written(met.filter("n IS NOT NULL").unionByName(cold), "dedup-classed")

    single = classed.filter("n = 1").select("id", "at", "text_sha256", "stays", F.col("n").alias("group_size"))
    checked = _checked(table, classed.filter("n > 1"), places, piece, text_column, fresh)
    stays = F.col("stays")
    return (single.unionByName(checked)
            .select(F.col("id").alias("doc_id"), stays["id"].alias("keep_id"), "group_size",
                    (F.col("at") == stays["at"]).alias("kept"), "text_sha256", "at", stays["at"].alias("keep_at")))


def _checked(table: DataFrame, hits: DataFrame, places: DataFrame, piece: int, text_column: str, fresh: bool) -> DataFrame:
    """Rows that share a digest, each compared in full with the one that
    stays. Texts are fetched by place."""
    spark = table.sparkSession
    texts = _texts_in(table, text_column)
    # Hits are hashed per partition; the texts need no sort.
    full = written(texts.join(hits.hint("shuffle_hash"), hits["at"] == F.col("of")).select("id", "at", "digest", "text_sha256", "stays", "n", "text"), "dedup-hits")
    here = full.filter(F.col("at") == F.col("stays.at"))
    first = here.select("digest", "n", "text")
    if not fresh:
        before = hits.select("digest", "n", F.col("stays.at").alias("at")).distinct().join(here.select("digest"), "digest", "left_anti")
        if names := _files(before):
            earlier = _texts_in(spark.read.parquet(*names), text_column)
            first = first.unionByName(earlier.join(before.hint("shuffle_hash"), F.col("of") == before["at"]).select("digest", "n", "text"))
    salts = F.ceil(F.col("n") / piece).cast("int")
    salted = full.withColumn("salt", F.pmod(F.xxhash64("at"), salts).cast("int"))
    first = first.select(F.col("digest").alias("first_digest"), F.col("text").alias("first_text"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("first_salt"))
    same = written(salted.join(first, (F.col("digest") == F.col("first_digest")) & (F.col("salt") == F.col("first_salt")))
                   .select("id", "at", "text_sha256", "digest", "stays", F.col("n").alias("group_size"), (F.col("text") == F.col("first_text")).alias("same")), "dedup-same")
    differ = same.filter("not same").select("digest").distinct()
    alike = same.select("id", "at", "text_sha256", "stays", "group_size")
    if differ.isEmpty():
        return alike
    # Collisions: all rows of such digests, by the whole text.
    again = written(places.join(differ, "digest", "left_semi"), "dedup-again")
    known = _texts_in(spark.read.parquet(*_files(again)), text_column)
    whole = written(known.join(again.hint("shuffle_hash"), F.col("of") == again["at"]).select("id", "at", "text"), "dedup-collided")
    groups = whole.groupBy("text").agg(F.min(_order()).alias("stays"), F.count("*").alias("group_size"))
    regrouped = whole.join(groups.withColumnRenamed("text", "group_text"), F.col("text") == F.col("group_text")).select(F.col("at").alias("of"), "stays", "group_size")
    alike = same.join(differ, "digest", "left_anti").select("id", "at", "text_sha256", "stays", "group_size")
    collided = same.join(differ, "digest", "left_semi").select("id", "at", "text_sha256")
    return alike.unionByName(collided.join(regrouped, F.col("at") == F.col("of")).select("id", "at", "text_sha256", "stays", "group_size"))
