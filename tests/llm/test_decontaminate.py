from __future__ import annotations

import random

import numpy as np
import pytest

from farepath.llm import decontaminate as dc
from farepath.llm.queries import op3_decontaminate
from tests.llm import edge


def distance_in(item, region):
    """Least edit distance of item to any part of region, cell by cell."""
    column = list(range(len(item) + 1))
    least = len(item)
    for word in region:
        after = [0]
        for i in range(1, len(item) + 1):
            after.append(min(column[i] + 1, after[i - 1] + 1, column[i - 1] + (item[i - 1] != word)))
        column = after
        least = min(least, column[-1])
    return least


def brute(docs, items, share=dc.DISTANCE):
    out = set()
    for doc_id, text in docs:
        words = dc.words_of(text or "")
        for item_id, item in items:
            wanted = dc.words_of(item or "")
            if wanted and distance_in(wanted, words) <= int(share * len(wanted)):
                out.add((doc_id, item_id))
    return out


def test_distance_by_columns_is_the_plain_one():
    rng = random.Random(5)
    for _ in range(300):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 9))]
        region = [rng.randrange(6) for _ in range(rng.randrange(0, 20))]
        assert dc.word_distance_in(np.array(item), np.array(region, dtype=np.int64)) == distance_in(item, region)


def corpus(n_items=25, copies=8, seed=2):
    """Items, and documents that hold them edited up to the threshold."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(700)]
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.35 else rng.choice(vocabulary)
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 60)))) for i in range(n_items)]
    docs, planted = [], 0
    for i, item in items:
        for _ in range(copies):
            words = item.split()
            for _ in range(rng.randrange(0, int(dc.DISTANCE * len(words)) + 1)):
                at, kind = rng.randrange(len(words)), rng.randrange(3)
                if kind == 0:
                    words[at] = word()
                elif kind == 1:
                    del words[at]
                else:
                    words.insert(at, word())
            filler = [word() for _ in range(rng.randrange(0, 300))]
            at = rng.randrange(len(filler) + 1)
            docs.append((len(docs), " ".join([*filler[:at], *words, *filler[at:]]) + "."))
            planted += 1
        docs.append((len(docs), " ".join(word() for _ in range(200))))
    return docs, items


def test_recall_and_precision_against_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    found = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got <= want  # every row is verified
    assert len(got) >= 0.97 * len(want) and len(want) >= 190


@pytest.mark.parametrize("n", [30, 60, 100, 300, 600])
@pytest.mark.parametrize("kind", ["deletions", "insertions", "mixed"])
def test_recall_with_all_edits_of_one_kind(n, kind):
    """Every edit that the threshold allows, at random places."""
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(700)]
    word = lambda: rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.35 else rng.choice(vocabulary)
    edits = int(dc.DISTANCE * n)
    items = [(i, [word() for _ in range(n)]) for i in range(200 if n <= 100 else 20)]
    block = dc.ItemBlock(items)
    rows = []
    for _, words in items:
        words = list(words)
        for _ in range(edits):
            edit = kind if kind != "mixed" else rng.choice(["deletions", "insertions", "replacements"])
            if edit == "deletions":
                del words[rng.randrange(len(words))]
            elif edit == "insertions":
                words.insert(rng.randrange(len(words)), word())
            else:
                words[rng.randrange(len(words))] = word()
        rows.append([word() for _ in range(50)] + words + [word() for _ in range(50)])
    numbers = np.array([block.number.get(w, 0) for row in rows for w in row])
    got = {(row, item) for row, item, _ in block.matches(numbers, np.array([len(row) for row in rows]))}
    assert sum((i, i) in got for i, _ in items) >= 0.99 * len(items)
    assert all(distance_in(items[i][1], rows[row]) <= edits for row, i in got if row != i)


def test_parts_cover_an_item_and_share_its_edits():
    for n in range(1, 400):
        cuts = dc._cut(n)
        assert cuts[0][0] == 0 and cuts[-1][1] == n and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
        assert all(0 < e - f <= dc.PART_WORDS for f, e in cuts)
        # More edits than every part's share are more than the item's.
        assert sum(int(dc.DISTANCE * (e - f)) + 1 for f, e in cuts) > int(dc.DISTANCE * n)


@pytest.mark.parametrize("distance", [0.3, 0.4])
def test_recall_at_a_wider_distance(distance):
    """Repetitions are measured for it; all still goes through the walks."""
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, words(40)) for i in range(100)]
    assert dc.repetitions(20, distance) > dc.REPETITIONS
    block, rows = dc.ItemBlock(items, distance), []
    for _, item in items:
        changed = list(item)
        for at in rng.sample(range(40), int(distance * 40)):
            changed[at] = "other"
        rows.append(words(30) + changed + words(30))
    numbers = np.array([block.number.get(w, 0) for row in rows for w in row])
    got = {(row, item) for row, item, _ in block.matches(numbers, np.array([len(row) for row in rows]))}
    assert sum((i, i) in got for i, _ in items) >= 97


def test_no_length_goes_round_the_walks():
    block = dc.ItemBlock([(0, [f"w{i}" for i in range(600)]), (1, ["a"] * 45), (2, ["b"])])
    assert all(len(tables) == dc.REPETITIONS for tables in block.tables.values())
    assert sum(len(words) for k, _, words in block.parts if k == 0) == 600


def test_blocks_of_items_give_the_same(spark):
    docs, items = corpus(10, 4, seed=9)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(r) for r in dc.contaminated(d, b).collect()}
    assert one == {tuple(r) for r in dc.contaminated(d, b, block_bytes=400).collect()}
    kept = {r["doc_id"] for r in dc.drop_contaminated(d, b, block_bytes=400).collect()}
    assert kept == {i for i, _ in docs} - {r[0] for r in one}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_over_the_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # Brute force over the items whose rare words a document holds in part.
    want = {(d, i) for d, i in brute([x for x in docs if len(x[1]) < 20_000], items)}
    got = {(r["doc_id"], r["item_id"]) for r in op3_decontaminate(spark, sf).collect()}
    short = {d for d, t in docs if len(t) < 20_000}
    assert {x for x in got if x[0] in short} == want


def test_edge_cases(spark):
    docs = edge.frame(spark)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "word"), (4, "quick brown fox jumps over the lazy dog"), (None, "two words"), (5, "two words"), (3, "word")],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in dc.contaminated(docs, items).collect()}
    assert got == {(1, 4, 0), (2, 4, 0), (6, 4, 0), (10, 3, 0), (11, None, 0), (11, 5, 0)}
    assert dc.contaminated(edge.frame(spark, []), items).collect() == []
    assert dc.contaminated(docs, items.limit(0)).collect() == []
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 6


def test_columns_of_any_name(spark):
    """Dots, and names that differ from the used ones by case alone."""
    docs = spark.createDataFrame([(1, "quick brown fox jumps over the dog", 1, "a", "b"), (2, "something else", 2, "a", "b")], ["doc_id", "text", "n.chars", "Text", "te xt`"])
    items = spark.createDataFrame([(1, "quick brown fox jumps over the dog")], "item_id long, text string")
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
    assert [r["doc_id"] for r in dc.contaminated(docs, items).collect()] == [1]
