from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
import pytest

from farepath.llm import token_counts
from farepath.llm.queries import op5_token_counts
from tests.llm import edge

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizer():
    return token_counts.reference_tokenizer(MODEL)


def test_counts_equal_the_librarys(tokenizer):
    rng = random.Random(4)
    letters = "aabbcdeeéèñßtthhe  .,\n\t▁|#$%&日本語🙂́ingionst"
    texts = ["", " ", "  ", " a", "a ", "a  b", "\n", "a\nb\n\nc", "▁x▁ y", "<0x41><s>", "🙂🙂", edge.LONG[:5000]]
    texts += ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(3000)]
    counter = token_counts.UnigramCounter(token_counts.vocabulary(MODEL))
    counts, _ = counter.count_all(pa.array(texts, pa.string()))
    assert counts.tolist() == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ties_go_to_the_first_start():
    from tokenizers import Tokenizer, models
    pieces = [("<unk>", 0.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("aa", -4.0), ("ba", -4.0), ("aba", -6.0), ("bb", -3.0)]
    own = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    counter = token_counts.UnigramCounter(pieces)
    rng = random.Random(7)
    for _ in range(500):
        word = "".join(rng.choices("ab", k=rng.randrange(1, 12)))
        assert counter.viterbi(word)[0] == len(own.encode(word).ids), word


def test_query_over_the_whole_table(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in docs}
    assert {r["doc_id"]: r["n_tokens"] for r in op5_token_counts(spark, sf).collect()} == want


def test_edge_cases(spark, tokenizer):
    rows = token_counts.token_counts(edge.frame(spark), MODEL).collect()
    want = sorted((r[0] or -1, len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in edge.rows())
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in rows) == want
    assert token_counts.token_counts(edge.frame(spark, []), MODEL).collect() == []


def test_an_unbroken_word_needs_little_memory():
    """Only the automaton's own copy of the word (4 bytes a letter) grows."""
    import tracemalloc
    counter = token_counts.UnigramCounter(token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    peaks = []
    for n in (20_000, 400_000):
        word = "▁" + "abcdefghij" * (n // 10)
        tracemalloc.start()
        counted = counter.viterbi(word)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert counted[0] > n // 20
    assert peaks[1] < peaks[0] + 4 * 400_000 + 10_000
