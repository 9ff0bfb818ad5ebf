from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from farepath.llm import quality
from farepath.llm.queries import op2_quality, quality_model
from tests.llm import edge

SF = "/root/testdata/sf0.01"


def test_tables_learn_a_step_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (4000, 3))
    y = ((x[:, 0] > 0.7) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    right = ((model.scores(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean()
    assert right > 0.9
    alone = quality.fit(x[:3000], y[:3000], n_pairs=0)
    assert right > ((alone.scores(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean()
    assert (1, 2) in model.pairs


def test_scores_are_additions_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    model = quality.fit(x, (x[:, 0] > 0).astype(float), rounds=5, pair_rounds=3, n_pairs=2)
    for row, score in zip(x[:20], model.scores(x[:20])):
        total = model.intercept
        bins = [int(np.searchsorted(e, v, side="right")) for e, v in zip(model.edges, row)]
        total += sum(t[b] for t, b in zip(model.tables, bins))
        total += sum(t[bins[i], bins[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9


def test_features_read_the_whole_text():
    calm = "some plain words that follow each other " * 3000
    assert quality.features_of(calm) != quality.features_of(calm + "!!! " * 50)
    assert quality.features_of("") == [0.0] * len(quality.FEATURES)


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op2_quality(spark, SF).collect()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == n and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    changed = labels.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_model(docs, labels), quality_model(docs, changed)
    assert all((s == t).all() for s, t in zip(a.tables, b.tables))


def test_edge_cases(spark):
    docs = edge.frame(spark)
    model = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(edge.rows()) and {r["score"] for r in rows} == {0.5}
    labels = spark.createDataFrame([(1, 1), (7, 0), (7, None), (None, 1), (1, 1), (99, 0)], "doc_id long, quality int")
    learned = quality.learn(docs, labels, F.lit(True))
    kept = quality.keep_quality(docs, learned, 0.0)
    assert kept.schema.names == docs.schema.names and kept.count() == docs.count()
    assert quality.keep_quality(docs, learned, 1.1).count() == 0
    assert quality.score(edge.frame(spark, []), learned).collect() == []
