"""Mixing sources to target weights.

Words per source give the target of each source: a share of the whole
budget by weight, at most twice the source's own words; what a source cannot
take is shared again among the others by weight. A document is then taken
``floor(rate)`` times, rate = target / words of its source, and once more
where a number drawn from a hash of the document is below the fraction.

The hash is seeded. Of the given seeds each source uses the one whose draws
bring its words nearest to its target, so a source with few or very uneven
documents comes near it too. A seed's draws are independent of the texts'
sizes, and the same in every run.

Edge cases: a NULL text has no words and a NULL source is a source of its
own, the last; a source without words has target 0 and none of its documents
are taken; repeated rows are drawn alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farepath.llm.common import text_of, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MOST_TIMES = 2
SEEDS = tuple(range(1, 17))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _draw(digest: Column, seed: Column) -> Column:
    """A number in [0, 1) for each document and seed."""
    hexed = F.substring(F.md5(F.concat_ws(":", digest, seed.cast("string")).cast("binary")), 1, 8)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(2.0 ** 32)


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT,
                   most_times: int = MOST_TIMES) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows ``source``, ``size``.

    Sources fill up in order of cap / weight. When those before one are full
    the water level is (budget - their caps) / (weights of the rest). It
    falls from the first source that it doesn't fill, whose level, the largest
    of those, holds for that source and all after it.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    rows = (per_source.withColumn("weight", weight)
            .withColumn("cap", F.col("source_size") * most_times)
            .withColumn("budget", F.sum("source_size").over(every) * budget_percent)  # in hundredths
            .withColumn("weights", F.sum("weight").over(every)))
    filling = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(filling), F.lit(0))
    level = (F.col("budget") - 100 * before("cap")) / (100 * (F.col("weights") - before("weight")))
    rows = rows.withColumn("level", level)
    full = F.col("cap") <= F.col("level") * F.col("weight")
    final = F.max(F.when(~full, F.col("level"))).over(every)
    target = F.when(full | F.col("source_size").isNull(), F.col("cap").cast("double")).otherwise(F.coalesce(final, F.col("level")) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def _digest(id_column: str, text_column: str) -> Column:
    """What a document's draws are made from."""
    return F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit("t"), F.md5(text_of(text_column).cast("binary"))).cast("binary"))


def document_sizes(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """``doc_id``, ``digest``, ``source``, ``size``, written to the scratch
    folder: the texts are read once for all that follows."""
    return written(docs.select(F.col(id_column).alias("doc_id"), _digest(id_column, text_column).alias("digest"),
                               F.col(source_column).alias("source"), word_count(text_of(text_column)).alias("size")), "mix-sizes")


def source_plan(sizes: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, most_times: int = MOST_TIMES, seeds=SEEDS) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``, and how
    its documents are taken: ``whole`` times, and once more where the draw of
    ``seed`` is below ``part``. Written to the scratch folder."""
    targets = source_targets(sizes, weights, budget_percent, most_times)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = targets.withColumn("whole", F.floor(rate)).withColumn("part", rate - F.floor(rate)).alias("t")
    rows = sizes.alias("s").join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.digest", "s.size", "t.*")
    sums = rows.groupBy("source").agg(
        *[F.first(c).alias(c) for c in ("source_size", "target", "whole", "part")],
        *[F.sum(F.when(_draw(F.col("digest"), F.lit(k)) < F.col("part"), F.col("size")).otherwise(0)).alias(f"sum_{k}") for k in seeds])
    off = lambda k: F.abs(F.col("whole") * F.col("source_size") + F.col(f"sum_{k}") - F.col("target"))
    nearest = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(k).alias("seed")) for k in seeds]))["seed"]
    return written(sums.select("source", "source_size", "target", "whole", "part", nearest.alias("seed")), "mix-sources")


def _copies(digest: Column, plan: str) -> Column:
    return F.col(f"{plan}.whole") + (_draw(digest, F.col(f"{plan}.seed")) < F.col(f"{plan}.part")).cast("long")


def mixed_sizes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """One row per document: ``doc_id``, ``digest``, ``source``, ``size``,
    ``source_size``, ``target``, ``copies``, ``taken``."""
    sizes = document_sizes(docs, id_column, text_column, source_column)
    rows = sizes.alias("s").join(source_plan(sizes, **options).alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
    return (rows.select("s.doc_id", "s.digest", "s.source", "s.size", "p.source_size", "p.target", _copies(F.col("s.digest"), "p").alias("copies"))
            .withColumn("taken", F.col("copies") * F.col("size")))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken.
    A document's copies follow from itself and its source's one row of the
    plan, so the texts meet only that small table."""
    plan = source_plan(document_sizes(docs, id_column, text_column, source_column), **options)
    name = _unused(docs.columns, "copies")
    rows = docs.alias("d").join(plan.alias("p"), F.col(f"d.{source_column}").eqNullSafe(F.col("p.source")))
    copies = _copies(_digest(f"d.{id_column}", f"d.{text_column}"), "p")
    taken = rows.select("d.*", copies.alias(name)).filter(F.col(name) > 0)
    return taken.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(name)))).drop(name)


def _unused(columns: list[str], name: str) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name
