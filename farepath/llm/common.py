"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farepath.session import new_scratch_path

#: Characters of text that a task handles at once.
SLICE_CHARS = 4_000_000
#: Bytes of an Arrow batch.
BATCH_BYTES = "8m"
#: Entries after which a task's word memo is emptied.
MEMO_ENTRIES = 300_000


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table.select(*columns) if columns else table


def text_of(column: str) -> Column:
    """The text, NULL as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a NULL id, which no
    label can name."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds, F.lit(-1))


def keep_batches_small(spark: SparkSession) -> None:
    """As in :func:`small_batches`, from now on: for the rows of a job's step
    that another writes. A size that the session was given stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most :data:`BATCH_BYTES` for the jobs run inside,
    so that neither side of a Python task holds much text at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: what
    follows starts from the files, whichever executors are lost."""
    path = new_scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(rows: DataFrame, id_column: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, those of the smallest id hashes: the same
    rows in every run."""
    return rows.orderBy(F.xxhash64(id_column), F.col(id_column)).limit(bound)


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``chars`` characters each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def by_slice(ids: pa.Array, texts: pa.StringArray, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.Array, pa.StringArray]]:
    """The rows of two Arrow columns, about ``chars`` bytes of text at once."""
    ends = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy()))
    lo = 0
    while lo < len(ids):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + chars, "right")) - 1)
        yield ids.slice(lo, hi - lo), texts.slice(lo, hi - lo)
        lo = hi
        give_back()


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its tasks
    and stages, and stands beside the executor's other memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, build: Callable[[], object]):
    """What ``build`` makes, kept for later tasks of a Python worker, which
    holds one such thing at a time: that of the operator it last served."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = build()
    return _KEPT[key]


def let_go() -> None:
    """Free what :func:`kept` holds for another operator."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def filtered_rows(docs: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` for which ``keep``, asked about a batch whose
    columns are those of ``docs`` by place, says so. Whatever the columns are
    called, they come out as they went in."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    placed = docs.toDF(*names)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep(batch), pa.bool_()))
            give_back()

    return placed.mapInArrow(run, placed.schema).toDF(*docs.columns)


def placed(docs: DataFrame, **columns: str) -> DataFrame:
    """The named columns (new name = old name) and no other. A name is taken
    as it is spelt: other columns may differ from it by case, or hold dots."""
    by_place = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return by_place.select(*[F.col(f"c{docs.columns.index(old)}").alias(new) for new, old in columns.items()])


def columns_of(batch: pa.RecordBatch, *names: str) -> list:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def record_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type)
              for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, element by element (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
