from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from farepath.llm import toxicity
from farepath.llm.queries import op10_toxicity
from tests.llm import edge


def enumerate_paths(u, transitions):
    """Marginals, partition sum and expected transitions by all label paths."""
    ct, tc, tt = transitions
    step = {(0, 0): 0.0, (0, 1): ct, (1, 0): tc, (1, 1): tt}
    total, toxic, expected = 0.0, np.zeros(len(u)), np.zeros(3)
    for path in itertools.product((0, 1), repeat=len(u)):
        weight = np.exp(sum(u[i] for i, y in enumerate(path) if y) + sum(step[p] for p in zip(path, path[1:])))
        total += weight
        toxic += weight * np.array(path)
        for p in zip(path, path[1:]):
            if p != (0, 0):
                expected[[(0, 1), (1, 0), (1, 1)].index(p)] += weight
    return toxic / total, np.log(total), expected / total


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 0, 7, 1, 5])
    u, transitions = rng.normal(size=16), (0.7, -0.4, 1.3)
    p, log_z, expected = toxicity._messages(u, lengths, transitions, pairs=True)
    assert np.allclose(p, toxicity._messages(u, lengths, transitions)[0])
    parts = [enumerate_paths(u[e - n:e], transitions) for n, e in zip(lengths, np.cumsum(lengths)) if n]
    assert np.allclose(p, np.concatenate([x[0] for x in parts]))
    assert np.isclose(log_z, sum(x[1] for x in parts)) and np.allclose(expected, sum(x[2] for x in parts))


def test_learns_words_and_beginnings():
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "ru", "fe", "do", "zu") for b in ("len", "tor", "san", "wik") for c in ("", "a", "en", "ot", "is", "um")]
    documents, toxic = [], []
    for i in range(200):
        words = list(rng.choice(plain, 30))
        if i % 2:
            words[5:5] = [rng.choice(["vile", "grubzat" + rng.choice(plain)])]
        documents.append(words)
        toxic.append(i % 2)
    tokens = toxicity.coded(documents)
    model = toxicity.fit(tokens, toxicity.label_tokens(tokens, toxic))
    new = ["balen", "grubzatnew", "kotor"]
    p = model.marginals(np.array([model.emission(w) for w in new]), np.array([3]))
    assert p[1] > 0.5 and p[0] < 0.2 and p[2] < 0.2


def small_corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "ru", "fe", "do", "zu", "ly") for b in ("len", "tor", "san", "wik", "pag", "nu") for c in ("", "a", "en", "ot", "is", "um", "ir", "ek")]
    documents = [[str(w) for w in rng.choice(words, rng.integers(0, 25))] for _ in range(n)]
    toxic = [int(i % 3 == 0) for i in range(n)]
    for d, t in zip(documents, toxic):
        if t and rng.random() < 0.9:
            d.insert(int(rng.integers(0, len(d) + 1)), str(rng.choice(["vile", "grubzat" + str(rng.choice(words)), "grubzat"])))
    return documents, toxic


def test_gradient_against_differences():
    documents, toxic = small_corpus(5, 40)
    documents[1] = documents[1] * 60  # longer than a cut
    tokens = toxicity.coded(documents)
    likelihood = toxicity.Likelihood(tokens, toxicity.label_tokens(tokens, toxic) | (np.arange(len(tokens.flat)) % 11 == 0), l2=0.3)
    assert likelihood.lengths.max() <= toxicity.CUT and likelihood.lengths.sum() == len(tokens.flat)
    theta = np.random.default_rng(1).normal(size=len(likelihood.names) + 4) * 0.3
    _, gradient = likelihood.at(theta)
    for i in [0, 3, len(theta) // 2, *range(len(theta) - 4, len(theta))]:
        step = np.zeros(len(theta))
        step[i] = 1e-5
        slope = (likelihood.at(theta + step)[0] - likelihood.at(theta - step)[0]) / 2e-5
        assert np.isclose(gradient[i], slope, rtol=1e-4, atol=1e-4)


def test_fit_reaches_a_higher_likelihood():
    tokens = toxicity.coded((made := small_corpus(6))[0])
    y = toxicity.label_tokens(tokens, made[1])
    model = toxicity.fit(tokens, y)
    likelihood = toxicity.Likelihood(tokens, y)
    theta = np.array([model.weights.get(f, 0.0) for f in likelihood.names] + [model.bias, *model.transitions])
    assert y.any() and likelihood.at(theta)[0] > likelihood.at(np.zeros(len(theta)))[0]


def slow_marking(documents, toxic, least, ratio):
    """With sets, document by document."""
    kept = toxicity._without_copies(toxicity.coded(documents))
    features = {i: {f for w in documents[i] for f in toxicity.token_features(w)} for i in kept}
    count = [{f: sum(f in features[i] for i in kept if toxic[i] == k) for i in kept for f in features[i]} for k in (0, 1)]
    n = [max(1, sum(toxic[i] == k for i in kept)) for k in (0, 1)]
    able = {f for f, m in count[1].items() if m >= least and m / n[1] >= ratio * (count[0][f] + 0.1) / n[0]
            and toxicity._evidence(m, n[1], count[0][f], n[0]) >= toxicity.LEAST_EVIDENCE}
    left, marking = {i for i in kept if toxic[i]}, set()
    while able:
        best = max(able, key=lambda f: (sum(f in features[i] for i in left), f.startswith("b"), len(f), f))
        explained = {i for i in left if best in features[i]}
        if len(explained) < least:
            break
        marking.add(best)
        left -= explained
    return marking | {f for f in able if count[1][f] >= max(least, toxicity.COMMON_SHARE * n[1])}


def test_marking_features_against_sets():
    for seed in range(4):
        documents, toxic = small_corpus(seed)
        documents += documents[:7]  # copies
        toxic += toxic[:7]
        tokens = toxicity.coded(documents)
        marking = toxicity.marking_features(tokens, toxic)
        assert marking and marking == slow_marking(documents, toxic, toxicity.LEAST_DOCUMENTS, toxicity.LEAST_RATIO)
        y = toxicity.label_tokens(tokens, toxic)
        slow = [t and any(f in marking for f in toxicity.token_features(w)) for d, t in zip(documents, toxic) for w in d]
        assert y.tolist() == [bool(x) for x in slow]


def test_training_is_bounded_in_bytes_and_rows(spark, monkeypatch):
    """A repeated row is one document; a long text and what goes beyond the
    bytes of a label are left out, the smallest id hashes stay."""
    rows = [(i, f"word{i:06d}") for i in range(100)] + [(3, "word000003")] * 50 + [(-1, "y" * 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(100), -1, -1]], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda tokens, y: seen.append(tokens))
    toxicity.learn(docs, labels, F.lit(True))
    assert len(seen[0].lengths) == 101
    toxicity.learn(docs, labels, F.lit(True), training_bytes=640)
    order = [r["id"] for r in spark.range(100).orderBy(F.xxhash64("id")).collect()]
    kept = [i for i in order if i % 2][:16] + [i for i in order if i % 2 == 0][:48]
    assert sorted(seen[1].words) == sorted(f"word{i:06d}" for i in kept)


def test_held_out_accuracy_and_spans(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op10_toxicity(spark, sf).collect()
    assert len(rows) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all((r["spans"] != "") == (r["predicted"] == 1) for r in rows)
    for r in rows:
        for span in filter(None, r["spans"].split(",")):
            a, b = map(int, span.split(":"))
            assert texts[r["doc_id"]][a:b].strip() and texts[r["doc_id"]][a:b].lower() == texts[r["doc_id"]][a:b].lower().strip()
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert np.mean([b for a, b in held if not a]) < 0.02


def test_edge_cases(spark):
    docs = edge.frame(spark)
    labels = spark.createDataFrame([(1, 0), (7, 0), (9, 1), (8, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(edge.rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 and r["spans"] == [] for r in rows if r["doc_id"] in (3, 4, 5))
    none = toxicity.learn(docs, labels.filter("toxic = 0"), F.lit(True))
    assert all(r["score"] < 0.1 for r in toxicity.score(docs, none).collect())
    nothing = toxicity.learn(docs, labels.limit(0), F.lit(True))
    assert all(r["score"] < 0.1 for r in toxicity.score(docs, nothing).collect())
    assert toxicity.score(edge.frame(spark, []), model).collect() == []


def test_offsets_are_those_of_the_given_text(spark):
    """Letters whose lower-case form is longer, or that take a mark."""
    model = toxicity.ChainField({"w:vile": 9.0}, -4.0, (0.0, 0.0, 0.0))
    for text in ["İstanbul is vile", "İİİ VILE İ", "ẞ straẞe vile", "e\u0301te\u0301 vile", "ΑΣ'Σ vile", "vile"]:
        (row,) = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
        assert [text[x["start"]:x["end"]].lower() for x in row["spans"]] == ["vile"], text
