from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from farepath.llm import mixing
from farepath.llm.queries import QUALITY_AT_LEAST
from tests.llm import edge
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dup import classes
from tests.llm.test_token_ids import expected

SF = "/root/testdata/sf0.001"


def test_order_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "mixing", "token_ids"]


def test_every_stage_against_brute_force(spark):
    from farepath.llm import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, SF).persist()
    model = corpus_pipeline.quality_model(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in good.collect()} == {d for d, s in scores.items() if s >= QUALITY_AT_LEAST}

    single = stages["near_copies"](spark, good, SF).persist()
    kept = {r["doc_id"] for r in single.collect()}
    of = classes([(r["doc_id"], r["text"]) for r in good.collect()])
    assert single.columns == docs.columns and kept == set(of.values())

    clean = stages["decontamination"](spark, single, SF).persist()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, _ in contaminated([(d, texts[d]) for d in kept], items)}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == kept - dirty

    mixed = stages["mixing"](spark, clean, SF).persist()
    plan = {r["doc_id"]: r["copies"] for r in mixing.mixed_sizes(clean).collect() if r["copies"]}
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == plan

    rows = stages["token_ids"](spark, mixed, SF).collect()
    want = expected([(r["doc_id"], r["text"]) for r in mixed.collect()])
    assert sorted((tuple(r) for r in rows), key=lambda r: r[1]) == want
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((tuple(r) for r in whole.collect()), key=lambda r: r[1]) == want
    for frame in (good, single, clean, mixed):
        frame.unpersist()


def test_edge_cases(spark, out_dir):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    root = edge.as_tables(spark, out_dir, edge.frame(spark).withColumn("n.x", F.lit(1)), labels)
    rows = corpus_pipeline.run(spark, root).collect()
    known = {r[0] for r in edge.rows()}
    assert rows and {r["doc_id"] for r in rows} <= known
    starts = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:k]) for k in range(len(starts))] and all(n >= 1 for _, n in starts)
    again = corpus_pipeline.run(spark, root).collect()
    assert sorted(map(tuple, again), key=lambda r: r[1]) == sorted(map(tuple, rows), key=lambda r: r[1])


def test_empty_tables(spark, out_dir):
    root = edge.as_tables(spark, out_dir, edge.frame(spark, []))
    assert corpus_pipeline.run(spark, root).collect() == []


def test_quality_stage_sends_small_batches(spark):
    from farepath.llm import common

    class Counting:
        """Scores 1 for batches of at most 10 MB of text (10 kB a row)."""
        def scores(self, x):
            return (np.ones if len(x) <= 1_000 else np.zeros)(len(x))

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    model, corpus_pipeline.quality_model = corpus_pipeline.quality_model, lambda docs, labels: Counting()
    try:
        docs = spark.range(0, 3_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 909).alias("text"))
        assert corpus_pipeline.keep_quality(spark, docs, SF).count() == 3_000
        spark.conf.set(name, "1m")
        common.keep_batches_small(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        corpus_pipeline.quality_model = model
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_a_worker_keeps_the_tables_of_one_operator():
    import public_tokenizers

    from farepath.llm import common, decontaminate, near_dup, token_ids

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_ids._encoder(path)
    assert token_ids._encoder(path) is encoder and list(common._KEPT.values()) == [encoder]
    block = decontaminate._block([(1, ["a", "b", "c"])], 0.2)
    assert decontaminate._block([(1, ["a", "b", "c"])], 0.2) is block and list(common._KEPT.values()) == [block]
    batch = pa.record_batch({"id": [1], "mark": [1], "text": ["a b c"]})
    assert [t.to_pylist() for _, _, t in near_dup._marked(batch)] == [["a b c"]] and not common._KEPT
