"""Benchmark decontamination by the CGK embedding and bit-sampling LSH.

Texts are sequences of words (lower case, marks at both ends stripped). A
document is contaminated by an item if some window of it is within a word
edit distance of a fifth of the item's length.

*Windows.* An item's windows are as long as the item and start at any word of
a document. Most can't hold a match: with k edits allowed and the item cut
into k + 1 pieces, one piece must stand in the document unchanged. So only
windows where a piece of an item of that length stands in its place, give or
take k words, are looked at further; nothing is lost by it.

*Embedding.* A CGK random walk reads a sequence while it writes 3n symbols: at
step j it writes the symbol it stands on and moves on if a random bit, drawn
for j and the symbol, is 1. Two sequences at a small edit distance fall into
step again after each edit, so they agree in most places of the Hamming space.

*Bit sampling.* Each of several repetitions has a walk of its own and reads
``SAMPLED`` random places of it; equal symbols there make a candidate. The
walks of a pair at the threshold agree the less, the longer the sequences are.
So an item is cut into parts of at most ``PART_WORDS`` words, and each part is
looked for by itself: of the edits that the threshold allows to the item, some
part has no more than its share. One part found makes the whole item a
candidate, at the place that the part gives. The repetitions are as many as
reach ``RECALL`` for a part at the threshold; for a wider distance than usual
their number follows from measuring walks of random pairs at that distance.

*Verification.* The words around a candidate must hold all but a fifth of the
item's words, in any order (no match holds fewer); then comes the exact edit
distance of the item to the best-placed part of the document there.

The benchmark is a stated query set: it is read in blocks of bounded bytes,
and each block goes over all documents in one pass without a shuffle. Between
two blocks the result so far is written, so the driver and the plan hold one
block (and the one that comes next), however many there are.

Edge cases: NULL and empty texts match nothing, nor do items without words;
repeated items match each for itself; rows that share an id are reported
under it once for each item.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farepath.llm.common import by_slice, columns_of, filtered_rows, kept, mix64, placed, record_batch, text_of, written
from farepath.session import new_scratch_path

DISTANCE = 0.2
SAMPLED = 2
#: Longest parts of an item that are embedded, in words.
PART_WORDS = 30
#: Share of the parts at the threshold that the repetitions find, and their
#: number at the usual distance, whether the edits are deletions, insertions,
#: replacements or mixed. Measured with these walks: 13 were enough.
RECALL, REPETITIONS = 0.99, 21
#: Pairs and walks from which the agreement at other distances is measured.
MEASURED_PAIRS, MEASURED_WALKS = 300, 12
#: Bytes of items that are sent to the tasks at once.
BLOCK_BYTES = 8_000_000
#: Bytes of documents that a task looks through at once.
SLICE_BYTES = 4_000_000

STRIPPED = ".,;:!?\"'()[]{}<>|*#$%&@^~+=/\\_-`»«“”„…"


@functools.lru_cache(maxsize=256)
def repetitions(n: int, distance: float = DISTANCE) -> int:
    """Walks for parts of ``n`` words."""
    if distance <= DISTANCE:
        return REPETITIONS
    rng = np.random.default_rng(n)
    edits, least = int(distance * n), 1.0
    for kind in ("deletions", "insertions", "replacements"):
        pairs = []
        for _ in range(MEASURED_PAIRS):
            words = rng.integers(1, 5000, n)
            at = rng.choice(n, min(edits, n - 1), replace=False)
            other = np.delete(words, at) if kind == "deletions" else np.insert(words, at, rng.integers(1, 5000, len(at)))
            if kind == "replacements":
                other = words.copy()
                other[at] = rng.integers(5000, 10000, len(at))
            pairs += [words, np.append(other, rng.integers(1, 5000, n))[:n]]
        flat, starts = np.concatenate(pairs), np.arange(len(pairs)) * n
        hashes = mix64(np.arange(10_000, dtype=np.uint64))
        agree = [np.mean(key[::2] == key[1::2]) for key in _walk_keys(hashes, flat, starts, starts + n, n, MEASURED_WALKS, {})]
        least = min(least, float(np.mean(agree)))
    return int(np.ceil(np.log(1 - RECALL) / np.log1p(-max(least, 1e-4)))) + 1


def _walk_keys(hashes: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, times: int, bits: dict) -> Iterator[np.ndarray]:
    """For each repetition the sampled key of the walk over each window of
    ``n`` words. ``hashes`` are those of the words by number; ``bits`` keeps
    the walks' random bits."""
    for r in range(times):
        draws = mix64(np.arange(8 * SAMPLED, dtype=np.uint64) ^ np.uint64((r + 1) * 0x9E3779B1 + n))
        # Places among the steps that a walk over n words makes before its end.
        places = sorted(_places(draws, 2 * n, SAMPLED))
        key = mix64(np.full(len(starts), (r << 20) ^ n, dtype=np.uint64))
        at = starts.copy()
        for step in range(places[-1] + 1):
            symbol = np.where(at < ends, words[np.minimum(at, len(words) - 1)], 0)
            if step in places:
                key = mix64(key ^ hashes[symbol])
            moves = bits.get((r, step))
            if moves is None:
                moves = bits[r, step] = (mix64(hashes ^ np.uint64(((r + 1) << 32) + step)) & np.uint64(1)).astype(np.uint8)
            at = at + moves[symbol]
        yield key


def _plain(chunks: pa.StringArray) -> pa.StringArray:
    return pc.utf8_lower(pc.utf8_trim(chunks, characters=STRIPPED))


def words_of(text: str) -> list[str]:
    return [w for w in _plain(pc.utf8_split_whitespace(pa.array([text])).flatten()).to_pylist() if w]


def word_distance_in(item: np.ndarray, region: np.ndarray) -> int:
    """Least edit distance of ``item`` to any part of ``region``."""
    n = len(item)
    column = np.arange(n + 1)
    least = n
    places = np.arange(n + 1)
    for word in region:
        changed = np.empty(n + 1, dtype=np.int64)
        changed[0] = 0
        changed[1:] = np.minimum(column[:-1] + (item != word), column[1:] + 1)
        # Deletions run down the column: a running minimum.
        column = np.minimum.accumulate(changed - places) + places
        least = min(least, int(column[-1]))
    return least


#: For each size of piece: ordered hashes, what each is of, its place there.
Pieces = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _ordered(pieces: dict[int, set[tuple[int, int, int]]]) -> Pieces:
    out = {}
    for size, found in pieces.items():
        ordered = sorted(found)
        out[size] = (np.array([x[0] for x in ordered], dtype=np.uint64), np.array([x[1] for x in ordered]), np.array([x[2] for x in ordered]))
    return out


class ItemBlock:
    """A block of items with their LSH tables, built from the items' words."""

    def __init__(self, items: list[tuple[int, list[str]]], distance: float = DISTANCE):
        self.distance = distance
        vocabulary = sorted({w for _, words in items for w in words})
        #: Words of the benchmark from 1 on; 0 is any other word.
        self.number = {w: i for i, w in enumerate(vocabulary, start=1)}
        self.hashes = np.array([0, *(xxhash.xxh64_intdigest(w) for w in vocabulary)], dtype=np.uint64)
        self.items = [(item, np.array([self.number[w] for w in words], dtype=np.int64)) for item, words in items if words]
        self.bags = [np.unique(words, return_counts=True) for _, words in self.items]
        self._bits: dict[tuple[int, int], np.ndarray] = {}
        #: Parts: the item of each, its first word there, and its words.
        self.parts = [(k, first, words[first:end]) for k, (_, words) in enumerate(self.items) for first, end in _cut(len(words))]
        by_length = defaultdict(list)
        for p, (_, _, words) in enumerate(self.parts):
            by_length[len(words)].append(p)
        #: For each length of parts and repetition, key to parts; for each size
        #: of piece, the hashes of the pieces with part length and place.
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        pieces: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
        for n, members in by_length.items():
            flat = np.concatenate([self.parts[p][2] for p in members])
            starts = np.arange(len(members)) * n
            self.tables[n] = []
            for row in self.keys(flat, starts, starts + n, n):
                table = defaultdict(list)
                for p, key in zip(members, row.tolist()):
                    table[key].append(p)
                self.tables[n].append(table)
            n_pieces = int(self.distance * n) + 1
            size = n // n_pieces
            hashes = self._grams(flat, size)
            for j in range(n_pieces):
                place = j * n // n_pieces
                pieces[size].update((h, n, place) for h in hashes[starts + place].tolist())
        self.pieces = _ordered(pieces)

    def _grams(self, words: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each place on (the last places,
        where fewer follow, stay out)."""
        n = max(0, len(words) - size + 1)
        out = np.full(n, size, dtype=np.uint64)
        for i in range(size):
            out = mix64(out ^ self.hashes[words[i:i + n]])
        return out

    def keys(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """The sampled keys of the walks over windows of a part length ``n``."""
        return _walk_keys(self.hashes, words, starts, ends, n, repetitions(n, self.distance), self._bits)

    def _standing(self, pieces: Pieces, words: np.ndarray, row_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Where pieces stand in the words, with the part length that each is
        of and its place there; for one size of piece after the other."""
        known = np.append(0, np.cumsum(words > 0))
        for size, (hashes, owners, places) in pieces.items():
            if len(words) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            at = at[row_of[at] == row_of[at + size - 1]]
            grams = np.full(len(at), size, dtype=np.uint64)
            for i in range(size):
                grams = mix64(grams ^ self.hashes[words[at + i]])
            low, high = np.searchsorted(hashes, grams, "left"), np.searchsorted(hashes, grams, "right")
            hit = np.flatnonzero(high > low)
            count = (high - low)[hit]
            which = np.repeat(low[hit] - np.append(0, np.cumsum(count))[:-1], count) + np.arange(int(count.sum()))
            yield np.repeat(at[hit], count), owners[which], places[which]

    def windows(self, words: np.ndarray, row_of: np.ndarray, first_of: np.ndarray, end_of: np.ndarray) -> dict[int, np.ndarray]:
        """For each part length the starts of the windows that may hold a match."""
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for where, lengths, places in self._standing(self.pieces, words, row_of):
            for n in np.unique(lengths):
                of = lengths == n
                allowed = int(self.distance * n)
                middle = where[of] - places[of]
                starts = (middle[:, None] + np.arange(-allowed, allowed + 1)).reshape(-1)
                home = np.repeat(where[of], 2 * allowed + 1)
                starts = np.maximum(starts, first_of[home])
                found[int(n)].append(starts[starts < end_of[home]])
        return {n: np.unique(np.concatenate(some)) for n, some in found.items()}

    def _holds(self, k: int, region: np.ndarray, least: int) -> bool:
        """Whether the region has so many of the item's words, in any order."""
        words, counts = self.bags[k]
        at = np.minimum(np.searchsorted(words, region), len(words) - 1)
        there = np.bincount(at[words[at] == region], minlength=len(words))
        return int(np.minimum(there, counts).sum()) >= least

    def matches(self, words: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, distance) for the rows whose words (numbers, 0 for
        words outside the benchmark) stand one after the other."""
        ends = np.cumsum(sizes)
        row_of = np.repeat(np.arange(len(sizes)), sizes)
        end_of = np.repeat(ends, sizes)
        first_of = np.repeat(ends - sizes, sizes)
        candidates: set[tuple[int, int, int]] = set()
        for n, starts in self.windows(words, row_of, first_of, end_of).items():
            for table, keys in zip(self.tables[n], self.keys(words, starts, np.minimum(starts + n, end_of[starts]), n)):
                hit = np.flatnonzero(np.isin(keys, np.fromiter(table, dtype=np.uint64, count=len(table))))
                for h in hit.tolist():
                    start = int(starts[h])
                    for p in table[int(keys[h])]:
                        k, first, _ = self.parts[p]
                        candidates.add((int(row_of[start]), k, max(start - first, int(first_of[start]))))
        best: dict[tuple[int, int], int] = {}
        covered: dict[tuple[int, int], int] = {}
        for row, k, start in sorted(candidates):
            item, pattern = self.items[k]
            n, allowed = len(pattern), int(self.distance * len(pattern))
            # Windows that start close together share one region.
            if start < covered.get((row, k), -1) or best.get((row, k)) == 0:
                continue
            first = int(ends[row] - sizes[row])
            region = words[max(first, start - allowed - n // 4):min(int(ends[row]), start + n + allowed + max(n // 2, n // 4 + allowed))]
            covered[row, k] = start + n // 4 + 1
            if not self._holds(k, region, n - allowed):
                continue
            found = word_distance_in(pattern, region)
            if found <= allowed:
                best[row, k] = min(found, best.get((row, k), n))
        return [(row, self.items[k][0], d) for (row, k), d in sorted(best.items())]


def _cut(n: int) -> list[tuple[int, int]]:
    """First and end of the parts of ``n`` words, about equal in length."""
    m = -(-n // PART_WORDS)
    return [(j * n // m, (j + 1) * n // m) for j in range(m)]


def _block(items: list[tuple[int, list[str]]], distance: float) -> ItemBlock:
    """The tables of a block; a Python worker keeps those of the last one."""
    return kept(("block", xxhash.xxh3_128_intdigest(repr((distance, items)))), lambda: ItemBlock(items, distance))


def _places(draws: np.ndarray, steps: int, sampled: int) -> list[int]:
    out: list[int] = []
    for d in draws.tolist():
        place = int(d) % steps
        if place not in out:
            out.append(place)
        if len(out) == min(sampled, steps):
            break
    return out or [0]


def item_blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES):
    """The items as (id, words), a block of bounded bytes at a time."""
    rows = benchmark.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text")).orderBy("id", "text")
    block, size = [], 0
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        if words:
            block.append((row["id"], words))
            size += len(row["text"])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 item_column: str = "item_id", item_text_column: str = "text", distance: float = DISTANCE,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item found in it: ``doc_id``, ``item_id``,
    ``distance`` (word edits)."""
    kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64())])
    schema = "doc_id long, item_id long, distance long"
    named = placed(docs, id=id_column, text=text_column)
    rows = named.select(F.col("id").cast("long").alias("id"), text_of("text").alias("text"))
    spark = docs.sparkSession
    path, found = None, None
    for block, last in _with_last(item_blocks(benchmark, item_column, item_text_column, block_bytes)):
        def search(batches, block=block):
            items = _block(block, distance)
            for batch in batches:
                for ids, texts in by_slice(*columns_of(batch, "id", "text"), SLICE_BYTES):
                    matched = items.matches(*numbered(texts, items.number))
                    yield record_batch(kind, [ids.take(pa.array([m[0] for m in matched], pa.int64())), [m[1] for m in matched], [m[2] for m in matched]])

        found = rows.mapInArrow(search, schema)
        if path or not last:
            path = path or new_scratch_path(spark, "contaminated")
            found.write.mode("append").parquet(path)
    if found is None:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(path) if path else found
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def _with_last(blocks):
    """Each block, and whether it is the last."""
    blocks = iter(blocks)
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        yield block, following is None
        block = following


def numbered(texts: pa.StringArray, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the texts one after the other, and how many each has."""
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    plain = _plain(coded.dictionary)
    vocabulary = pa.array(number, pa.string())  # in order of its numbers, from 1 on
    found = pc.fill_null(pc.index_in(plain, value_set=vocabulary), -1).to_numpy() + 1
    numbers = np.where(pc.equal(plain, "").to_numpy(zero_copy_only=False), -1, found)
    words = numbers[coded.indices.to_numpy()] if len(plain) else np.zeros(0, dtype=np.int64)
    real = words >= 0
    counts = np.append(0, np.cumsum(real))
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
    return words[real], np.diff(counts[ends])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those in which an item was found; one
    pass over the table for each block of items, without a join. Between two
    blocks the rows that are left are written."""
    place = docs.columns.index(text_column)
    distance = options.get("distance", DISTANCE)
    for block, last in _with_last(item_blocks(benchmark, options.get("item_column", "item_id"), options.get("item_text_column", "text"),
                                              options.get("block_bytes", BLOCK_BYTES))):
        def clean(batch, block=block):
            items = _block(block, distance)
            texts = pc.fill_null(batch.column(place), "")
            keep = np.ones(batch.num_rows, dtype=bool)
            for rows, part in by_slice(pa.array(np.arange(batch.num_rows)), texts, SLICE_BYTES):
                for m in items.matches(*numbered(part, items.number)):
                    keep[rows[m[0]].as_py()] = False
            return keep

        docs = filtered_rows(docs, clean)
        if not last:
            docs = written(docs, "decontaminated")
    return docs
