from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from farepath.llm import language
from farepath.llm.queries import op6_language
from tests.llm import edge


def slow_vector(text, dimensions):
    """Letter by letter: rotate, bind, bundle."""
    letters = [c if c.isalpha() else " " for c in text.lower()]
    padded = [" "]
    for c in [*letters, " "]:
        if c != " " or padded[-1] != " ":
            padded.append(c)
    total = np.zeros(dimensions)
    for i in range(len(padded) - 2):
        bound = np.ones(dimensions)
        for place in range(3):
            c = padded[i + place]
            vector = language.letter_vectors(np.array([0 if c == " " else ord(c)], dtype=np.uint64), dimensions)[0]
            bound *= np.roll(vector, place)
        total += bound
    return total


def test_document_vectors_are_bundled_bound_letters():
    texts = ["Ça va bien?", "the  the\nTHE", "x", "12 !!", ""]
    vectors, known = language.document_vectors(texts, 128)
    assert known.tolist() == [True, True, True, False, False]
    for text, vector in zip(texts[:3], vectors):
        assert np.allclose(vector, slow_vector(text, 128))


def test_parts_of_a_text_count_as_the_whole():
    for text in ["", " ", "x", "  ab  cd\n", "ΑΣ ΣΑΣ", "a" * 9, "İ i\u0307 straße", "1 2 3", "ab--cd ef   g" * 5, "   x"]:
        whole = language.gram_counts(text)
        for part in (1, 2, 3, 5, 7):
            grams, counts, known = language.gram_counts(text, part)
            assert known == whole[2] and grams.tolist() == whole[0].tolist() and counts.tolist() == whole[1].tolist()


def test_one_very_long_text_takes_bounded_memory():
    """16 million characters with and without a break in them."""
    for text in ("word and another " * 950_000, "abcdefgh" * 2_000_000):
        language.gram_counts("warm")
        tracemalloc.start()
        language.gram_counts(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 150_000_000


def test_predictions_against_letter_by_letter_ones(spark):
    """Prototypes are the summed unit vectors of the training documents, the
    language the one of the largest cosine, the first of equal ones."""
    words = {"aa": "the house and that thing with those", "bb": "das haus und der ding mit jenen", "cc": "la casa y la cosa con esas"}
    rows = [(i, " ".join(np.roll(words[lang].split(), i)[:3 + i % 4]), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 4)]
    rows += [(100 + i, text, "zz") for i, (_, text, lang) in enumerate(rows) if lang == "aa"]  # zz has the documents of aa
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = ["those and that", "mit der", "con la casa", "zzz", "the", "und 12 das", "?!", None]
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    slow = {lang: unit(sum(unit(slow_vector(t, 256)) for _, t, of in rows if of == lang)) for lang in ("aa", "bb", "cc", "zz")}
    found = language.learn_prototypes(docs, F.lit(True), per_language=100, dimensions=256)
    assert sorted(found) == sorted(slow) and all(np.allclose(found[k], slow[k], atol=1e-5) for k in slow)
    found["zz"] = found["aa"]  # equal to the last bit: a true tie
    got = {r["doc_id"]: r for r in language.identify(edge.documents(spark, asked), found, dimensions=256).collect()}
    for i, text in enumerate(asked):
        if not text or not any(c.isalpha() for c in text):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cosines = [(-round(float(unit(slow_vector(text, 256)) @ slow[k]), 5), k) for k in slow]
        assert got[i]["lang_pred"] == min(cosines)[1] and np.isclose(got[i]["score"], max(0.0, -min(cosines)[0]), atol=1e-4)


def test_letter_vectors_are_nearly_orthogonal():
    vectors = language.letter_vectors(np.arange(97, 123, dtype=np.uint64), 4096)
    cosines = vectors @ vectors.T / 4096
    assert np.abs(cosines - np.eye(26)).max() < 0.08 and set(np.unique(vectors)) == {-1.0, 1.0}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op6_language(spark, sf).collect()
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95


def test_edge_cases(spark):
    docs = edge.frame(spark)
    prototypes = language.learn_prototypes(docs, F.lit(True), per_language=3)
    assert set(prototypes) == {"en", "de"}
    rows = language.identify(docs, prototypes).collect()
    assert len(rows) == len(edge.rows())
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] in (3, 4, 5))
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (7, 8)} == {"de"}
    assert {r["lang_pred"] for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.learn_prototypes(edge.frame(spark, []), F.lit(True)) == {}
    assert language.identify(edge.frame(spark, []), prototypes).collect() == []
