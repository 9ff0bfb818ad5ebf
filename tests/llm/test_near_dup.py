from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from farepath.llm import near_dup
from farepath.llm.queries import op9_near_dup
from farepath.plans.inspect import physical_plan
from tests.llm import edge


def bag(text):
    words = (text or "").lower().split()
    return Counter(zip(*[words[i:] for i in range(5)])) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def similarity(a, b):
    common = sum((a & b).values())
    return common / max(1, sum(a.values()) + sum(b.values()) - common)


def classes(rows, threshold=0.8):
    """Components of all pairs, one by one."""
    bags = {i: bag(t) for i, t in rows}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if bags[a] == bags[b] or similarity(bags[a], bags[b]) >= threshold:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def found(docs, **options):
    return {r["doc_id"]: r["class_id"] for r in near_dup.near_classes(docs, **options).collect()}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_signatures_estimate_weighted_jaccard_without_bias():
    rng = np.random.default_rng(0)
    weights = rng.integers(0, 40, (2, 60)) * (rng.random((2, 60)) < 0.7)
    shingles = near_dup.mix64(np.arange(60, dtype=np.uint64))
    n = 4000
    signatures = [near_dup.bag_min_hash(shingles[w > 0], w[w > 0], np.zeros((w > 0).sum(), dtype=np.int64), 1, n)[0] for w in weights]
    exact = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    assert abs((signatures[0] == signatures[1]).mean() - exact) < 4 * np.sqrt(exact * (1 - exact) / n)


def test_batches_do_not_change_signatures():
    texts = ["a b c d e f g", "x " * 300, "", "one", "the cat sat on the mat and the cat sat on the mat"]
    whole = near_dup.bag_min_hash(*near_dup.weigh(*near_dup.shingle_bags(pa.array(texts))), len(texts), 25)
    for i, text in enumerate(texts):
        alone = near_dup.bag_min_hash(*near_dup.weigh(*near_dup.shingle_bags(pa.array([text]))), 1, 25)
        assert (alone[0] == whole[i]).all()
    assert np.isinf(whole[2]).all() and np.isfinite(whole[[0, 1, 3, 4]]).all()


def test_occurrences_turn_bags_into_sets():
    a, b = "a b c d e " * 7 + "x y", "a b c d e " * 5 + "z"
    sets = []
    for text in (a, b):
        values, counts = near_dup.shingle_bags(pa.array([text]))
        sets.append(set(near_dup.occurrences(values, counts).tolist()))
        assert len(sets[-1]) == counts[0] == sum(bag(text).values())
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) == similarity(bag(a), bag(b))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.randrange(3, 200))
        texts.append(" ".join(words))
        for _ in range(rng.randrange(0, 8)):
            texts.append(edited(rng, words, rng.randrange(0, max(2, len(words) // 20))))
    rng.shuffle(texts)
    assert found(edge.documents(spark, texts)) == classes(list(enumerate(texts)))


def test_one_large_group_of_near_copies(spark):
    """Copies edited so that only some pairs reach the threshold: no link
    between components may be lost, in few comparisons."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    texts = [edited(rng, words, rng.choice([1, 2, 3, 4, 6, 9])) for _ in range(250)] + [" ".join(words)] * 30
    assert found(edge.documents(spark, texts)) == classes(list(enumerate(texts)))


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in parent if find(x) != x}
    got = {r["node"]: r["root"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_large_bags_at_the_threshold(spark):
    """Of so many elements some share their 32 bits: the pair at the threshold
    is no less a link for it, and the pair one element below it is none."""
    common, own = 640_000, 80_000  # 640,000 of 800,000
    elements = near_dup.mix64(np.arange(common + 3 * own + 1, dtype=np.uint64)).view(np.int64)
    shared, rest = elements[:common], elements[common:]
    bags = [np.append(shared, rest[i * own:(i + 1) * own]) for i in (0, 1)]
    bags.append(np.append(shared, rest[2 * own:]))  # one more than the others
    table = pa.table({"id": pa.array([1, 2, 3]), "bag": pa.array(bags, pa.list_(pa.int64())), "brief": pa.array([b.astype(np.int32) for b in bags], pa.list_(pa.int32()))})
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [tuple(r) for r in near_dup._verified(pairs, spark.createDataFrame(table), 0.8).collect()] == [(1, 2)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_texts_that_share_an_id(spark, seed):
    """Each text keeps its own copies, whichever row comes first."""
    rng = random.Random(seed)
    a, b, c = ([f"{name}{i}" for i in range(100)] for name in "abc")
    rows = [(1, "a", " ".join(a)), (1, "b", " ".join(b)), (1, "b", " ".join(b)), (2, "a", edited(rng, a, 1)), (3, "b", edited(rng, b, 1)),
            (4, "a", " ".join(a[:-1])), (4, "b", " ".join(b[1:])), (4, "c", " ".join(c)), (5, "c", edited(rng, c, 1)), (6, "c", " ".join(c))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, kind string, text string")
    got = near_dup.near_classes(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    sizes = Counter(r["class_id"] for r in got)
    assert sorted(sizes.values()) == [3, 3, 4]  # c, a, b
    assert all({i for i, k, _ in rows if k == kind} in [{r["doc_id"] for r in got if r["class_id"] == x} for x in sizes] for kind in "abc")
    kept = near_dup.drop_near_copies(docs).collect()
    assert sorted((r["doc_id"], r["kind"]) for r in kept) == [(1, "a"), (1, "b"), (4, "c")]


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["class_id"] for r in op9_near_dup(spark, sf).collect()} == classes(docs)


def test_edge_cases(spark):
    docs = edge.frame(spark)
    rows = near_dup.near_classes(docs).collect()
    assert len(rows) == len(edge.rows())
    by_id = {r["doc_id"]: r["class_id"] for r in rows}
    assert by_id[1] == by_id[2] == by_id[6] == 1 and by_id[3] == by_id[4] == by_id[5] == 3
    assert by_id[10] == 10 and by_id[11] == 11 and by_id[None] < 0
    kept = near_dup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda i: (i is None, i)) == [1, 3, 7, 8, 9, 10, 11, None]
    assert near_dup.near_classes(edge.frame(spark, [])).collect() == []
    assert near_dup.drop_near_copies(edge.frame(spark, [])).collect() == []


def test_a_fixed_row_of_repeated_ones_stays(spark):
    """Rows that share id and text but not the source, dealt in any order."""
    text = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(1, text, f"s{i}", i) for i in range(40)]
    kept = set()
    for order in (1, 3, 7):
        docs = spark.createDataFrame(sorted(rows, key=lambda r: r[3] * order % 41), ["doc_id", "text", "source", "n.chars"]).repartition(order)
        (row,) = near_dup.drop_near_copies(docs).collect()
        kept.add(tuple(row))
    assert len(kept) == 1


def templated(rng, n, share, links):
    """Texts that share a template of about ``share`` of their words, each
    with words of its own; ``links`` of them are copied with an edit."""
    template = [f"t{i}" for i in range(60)]
    texts = []
    for i in range(n):
        own = [f"own{i}x{k}" for k in range(round(60 / share) - 60 + rng.randrange(-3, 4))]
        texts.append([*template, *own])
    for words in rng.sample(texts, links):
        texts.append([*words[:-1], "edited"])
    return [" ".join(words) for words in texts]


@pytest.mark.parametrize("share", [0.72, 0.86])
def test_templates_below_the_threshold(spark, share):
    """A template makes all members of a large bucket alike; only the copies
    are linked."""
    texts = templated(random.Random(int(share * 100)), 160, share, 20)
    assert found(edge.documents(spark, texts)) == classes(list(enumerate(texts)))


def test_a_hub_of_the_components(spark):
    edges = [(0, i) for i in range(1, 2000)] + [(5000, 1999), (6000, 6001)]
    got = {r["node"]: r["root"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 2000)}, 5000: 0, 6001: 6000}


@pytest.mark.parametrize("marked", [False, True])
def test_plans_of_the_components_stay_small(spark, monkeypatch, marked):
    """The driver holds one star at a time, however many rounds and hubs there are."""
    numbers, plain = [], near_dup.written
    monkeypatch.setattr(near_dup, "written", lambda df, name: (numbers.append(physical_plan(df, "simple").count("Exchange ")), plain(df, name))[1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)], "a long, b long")
    if marked:  # nodes as the query has them
        edges = edges.select(*[F.struct(F.col(c).alias("id"), (-F.col(c)).alias("mark")).alias(c) for c in "ab"])
    rows = [(r["node"], r["root"]) for r in near_dup.components(edges).collect()]
    got = {x["id"]: y["id"] for x, y in rows} if marked else dict(rows)
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 400)} and len(rows) == len(got)
    assert len(numbers) > 3 and max(numbers) <= 4


def test_texts_are_signed_a_bounded_slice_at_a_time():
    texts = [f"{i} " + "word " * (i % 400) for i in range(4_000)]
    batch = pa.record_batch({"id": list(range(4_000)), "mark": [0] * 4_000, "text": texts})
    slices = [(ids.to_pylist(), some.to_pylist()) for ids, _, some in near_dup._marked(batch)]
    assert [i for ids, _ in slices for i in ids] == list(range(4_000)) and [t for _, some in slices for t in some] == texts
    assert max(sum(map(len, some)) for _, some in slices) <= 1_000_000


def test_bitmaps_leave_room_for_what_bags_share():
    rng = np.random.default_rng(5)
    pool = near_dup.mix64(np.arange(6_000, dtype=np.uint64)).view(np.int64)
    for size in (1, 50, 150, 1_000, 5_000):
        a, b = (rng.choice(pool[:size + size // 5 + 1], size, replace=False) for _ in range(2))
        bits, spare = near_dup.bitmaps(np.append(a, b), np.array([size, size]))
        assert bits.shape == (2, near_dup.BIT_WORDS)
        most = sum(int(x).bit_count() for x in (bits[0] & bits[1]).view(np.uint64)) + min(spare)
        shared = len(set(a.tolist()) & set(b.tolist()))
        assert shared <= most and (size > 150 or most <= shared + 0.1 * size + 2)
    empty, spare = near_dup.bitmaps(np.zeros(0, np.int64), np.array([0, 0]))
    assert not empty.any() and not spare.any()


@pytest.mark.parametrize("broadcast", [near_dup.BROADCAST_BYTES, 0])
def test_few_pairs_of_a_bucket_reach_the_bags(spark, monkeypatch, broadcast):
    """In a large bucket made by a template few pairs are intersected, and the
    few members outside the main component are broadcast, not dealt."""
    texts = templated(random.Random(4), 160, 0.72, 20)
    monkeypatch.setattr(near_dup, "BROADCAST_BYTES", broadcast)
    plans, plain = [], near_dup._near_pairs

    def kept(*args):
        pairs = plain(*args)
        plans.append(physical_plan(pairs, "simple"))
        return pairs

    monkeypatch.setattr(near_dup, "_near_pairs", kept)
    assert found(edge.documents(spark, texts)) == classes(list(enumerate(texts)))
    (plan,) = plans
    assert plan.index("bit_count") < plan.index("array_intersect")  # conditions stand in order
    assert "BroadcastHashJoin" in plan or not broadcast


@pytest.mark.parametrize("most", [near_dup.BROADCAST_ROOTS, 0])
def test_stars_with_few_and_with_many_rows(spark, monkeypatch, most):
    monkeypatch.setattr(near_dup, "BROADCAST_ROOTS", most)
    edges = [(0, i) for i in range(1, 1500)] + [(5000, 1499), (6000, 6001)] + [(i, i + 1) for i in range(7000, 7030)]
    got = {r["node"]: r["root"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 1500)}, 5000: 0, 6001: 6000, **{i: 7000 for i in range(7001, 7031)}}
    star = near_dup._with_least(spark.createDataFrame(edges, "node long, root long"), len(edges))
    assert ("Window" in physical_plan(star, "simple")) == (most == 0)
