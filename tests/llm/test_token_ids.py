"""Token files: exact round trips, and ids equal to the tokenizer's own."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from farepath.llm import token_ids
from farepath.llm.queries import op1_token_ids
from tests.llm import edge

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def decoded(blob):
    return list(token_ids.segments(blob))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700))
def test_round_trip_of_any_ids(values):
    ids = np.array(values, dtype=np.uint32)
    blob = token_ids.encode_segment([5, None], np.array([len(ids), 0]), ids) + b"\n"
    first, second = decoded(blob + blob)
    assert first.ids().tolist() == values and second.ids().tolist() == values
    assert first.doc_ids == [5, None] and first.lengths.tolist() == [len(ids), 0]


def test_range_reads_use_the_block_index():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 5000) % 49408).astype(np.uint32)
    segment = decoded(token_ids.encode_segment([0], np.array([5000]), ids) + b"\n")[0]
    for start, stop in ((0, 1), (127, 129), (128, 256), (1000, 4990), (4999, 5000), (10, 10)):
        assert segment.ids(start, stop).tolist() == ids[start:stop].tolist()


def test_outliers_go_to_the_exceptions():
    ids = np.full(128, 9, dtype=np.uint32)
    ids[[3, 77]] = 4_000_000_000
    segment = decoded(token_ids.encode_segment([0], np.array([128]), ids) + b"\n")[0]
    assert segment.n_exceptions == 2 and segment.n_packed == 0 and segment.place.tolist() == [3, 77]
    assert segment.ids().tolist() == ids.tolist()


def test_width_of_the_difference_to_the_minimum():
    ids = np.arange(1_000_000, 1_000_128, dtype=np.uint32)
    segment = decoded(token_ids.encode_segment([0], np.array([128]), ids) + b"\n")[0]
    assert segment.minimum.tolist() == [1_000_000] and segment.width.tolist() == [7]


def test_ids_equal_the_tokenizers_own():
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(TOKENIZER)
    random.seed(3)
    letters = "abcABC'stredvml 0189²½ªº.,!?\x85\xa0\t\n\x1c\x1f\x0b\x0c\x00\x7fÀéßÿ×÷<|>日Ωİ"
    texts = ["", " ", "it's ok's!", "<|endoftext|> x", "ΑΣ ΑΣ.", "éa", edge.LONG]
    texts += ["".join(random.choices(letters, k=random.randrange(40))) for _ in range(3000)]
    texts += [f"{chr(i)}a {chr(i)} x{chr(i)}y" for i in range(0x250)]
    for some in (texts, [t for t in texts if "<|" not in t]):
        ids, sizes = token_ids.WordwiseEncoder(TOKENIZER).encode_all(pa.array(some, pa.string()))
        found = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert found == [e.ids for e in own.encode_batch(some, add_special_tokens=False)]


def expected(rows):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(TOKENIZER)
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def order(rows):
    return sorted(rows, key=lambda r: r[1])


def test_files_of_edge_cases(spark, out_dir):
    docs = edge.frame(spark)
    token_ids.write_token_files(docs, out_dir, TOKENIZER, 1, file_chars=20_000)
    found = [tuple(r) for r in token_ids.token_index(spark, out_dir).collect()]
    assert order(found) == expected([(r[0], r[1]) for r in edge.rows()])
    ids = {r["doc_id"]: r["ids"] for r in token_ids.read_token_ids(spark, out_dir).collect()}
    assert ids[3] == [1] and ids[10][-1] == 1


def test_empty_table(spark, out_dir):
    token_ids.write_token_files(edge.frame(spark, []), out_dir, TOKENIZER, 1)
    assert token_ids.token_index(spark, out_dir).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_over_the_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert order([tuple(r) for r in op1_token_ids(spark, sf).collect()]) == expected([tuple(r) for r in rows])


def test_few_words_go_to_the_model_twice(monkeypatch):
    """The memo stays within its bounds, whatever the words, and gives the
    tokenizer's ids before and after it is emptied."""
    from tokenizers import Tokenizer
    own, encoder = Tokenizer.from_file(TOKENIZER), token_ids.WordwiseEncoder(TOKENIZER)
    asked, plain = [], encoder._words
    monkeypatch.setattr(encoder, "_words", lambda words: (asked.extend(words), plain(words))[1])
    rng = random.Random(2)
    common = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    monkeypatch.setattr(token_ids, "MEMO_WORDS", 2_000)
    for number in range(12):
        texts = [" ".join([*common, *(f"{w}{'xyz'[number % 3]}{'qrs'[number // 3 % 3]}," for w in common[:200]), ""]), "", "Abc ABC"]
        ids, sizes = encoder.encode_all(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
        assert len(encoder._memo[0]) == len(encoder._memo[1]) <= 2_001
    assert "" not in asked and len(asked) > len(set(asked)) and all(asked.count(w) == 1 for w in common[200:])
    monkeypatch.setattr(token_ids, "MEMO_BYTES", 100_000)
    for letter in "abc":
        ids, sizes = encoder.encode_all(pa.array([letter * 60_000], pa.string()))
        assert ids.tolist() == own.encode(letter * 60_000, add_special_tokens=False).ids
