"""Near copies by BagMinHash over word shingles.

A document is the bag of its five-word shingles (lower case, split at ASCII
white space; fewer than five words: one shingle of them all). Two documents
are near copies when the weighted Jaccard similarity of their bags is 0.8 or
more, and the classes are the connected components of these links.

*Signature.* A shingle of weight w owns the range [0, w). The ranges [0, 1),
[1, 2), [2, 4), [4, 8), ... each carry an independent Poisson process, seeded
by the shingle and the range; a point has a time, a signature component and
a place in its range, and counts if the place is below w. Each component
keeps its first point. Equal points of two documents are those below both
weights, so two components agree with probability equal to the similarity.
Points come in order of time and a process stops once its next point is later
than all of the document's components; a weight costs its logarithm.

*Bands.* 25 bands of 5 components: a pair at the threshold shares one with
probability 0.99995.

*Verification.* Documents with equal bags are one representative from the
start. Within a bucket, members aren't compared all with all. First each is
compared with the member that shares most buckets with others, the middle of
a group of copies, which joins most of the group into one component. Then
only pairs of different components are left, and each has a member outside
the component of the bucket's middle: those few members are compared with the
rest, inside the join, so that pairs below the threshold leave no row. A pair
that shares several buckets is compared in the first of them only. No link
between components is lost, and a group of copies costs a few comparisons a
member. The bags of a pair are intersected only if their bitmaps leave room for
the overlap: what two bags share is at most the bits that both have set, and the
elements that one of them lost to bits already set.

Edge cases: a NULL text counts as empty; documents without words form one
class. A NULL id stands for itself in the result; inside, a number below
-2**62 from the text's hash takes its place (and may be a class id). Rows that share
an id and a text are one document: when copies are dropped, one of them stays.
Texts that share an id are documents of their own, told apart by a hash of the
text beside the id (the mark). Where the classes of two of them would have the
same id, a number below -2**62 from the mark stands for the later one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from farepath.llm.common import by_slice, columns_of, let_go, mix64, record_batch, text_of, written
from farepath.operators.lookup import checked_broadcast
from farepath.operators.skew import PIECES

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 25, 5
#: Bytes of text that a task signs at once: its arrays take about 50 times as much.
SIGN_BYTES = 1_000_000
#: By how much the overlap of 32-bit hashes may be off the true one: so many
#: elements, and one more for each ``SLACK_SQUARE`` of the sizes' square. About
#: the square / 2**33 collide at most, 64 times fewer.
SLACK, SLACK_SQUARE = 2, 1 << 27
#: Longs of a bag's bitmap.
BIT_WORDS = 32
#: Keys of documents without an id are this number or less; ids are greater.
NO_ID = -(1 << 62)
#: Ids of documents in shared buckets up to which they are broadcast.
BROADCAST_IDS = 2_000_000
#: Rows of a star's edges up to which the least root of each node is broadcast.
BROADCAST_ROOTS = 200_000
#: Bytes of bucket members outside the main components up to which they are broadcast.
BROADCAST_BYTES = 64_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- shingles and signatures --------------------------------------------------

def shingle_bags(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, sorted within a text, repeats
    included; and how many belong to each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(texts)))
    coded = lists.flatten().dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), dtype=np.uint64, count=len(vocabulary))
    words = hashes[coded.indices.to_numpy()]
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sizes = np.where(np.array(pc.equal(pc.ascii_trim_whitespace(texts), "")), 0, sizes)
    multiplier = np.uint64(0xD6E8FEB86659FD93)
    n = len(words)
    with np.errstate(over="ignore"):
        n_rolled = max(0, n - SHINGLE_WORDS + 1)
        rolled = np.zeros(n_rolled, dtype=np.uint64)
        for i in range(SHINGLE_WORDS):
            rolled = rolled * multiplier + words[i:i + n_rolled]
        out, counts = [], np.zeros(len(sizes), dtype=np.int64)
        for d, (a, size) in enumerate(zip(starts.tolist(), sizes.tolist())):
            if size >= SHINGLE_WORDS:
                bag = np.sort(rolled[a:a + size - SHINGLE_WORDS + 1])
            elif size:
                short = np.uint64(size)
                for w in words[a:a + size]:
                    short = short * multiplier + w
                bag = np.array([short], dtype=np.uint64)
            else:
                continue
            out.append(bag)
            counts[d] = len(bag)
    return (mix64(np.concatenate(out)) if out else np.zeros(0, np.uint64)), counts


def weigh(bag: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their weights and the text each belongs to. Equal
    shingles of a text stand next to each other."""
    of = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(bag), dtype=bool)
    new[1:] = (bag[1:] != bag[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return bag[at], np.diff(np.append(at, len(bag))), of[at]


def bag_min_hash(shingles: np.ndarray, weights: np.ndarray, of: np.ndarray, n_texts: int, components: int) -> np.ndarray:
    """First times of the components (rows: texts); infinite without shingles."""
    first = np.full(n_texts * components, np.inf)
    levels = np.zeros(len(weights), dtype=np.int64)
    levels[weights > 1] = np.ceil(np.log2(weights[weights > 1])).astype(np.int64)
    element = np.repeat(np.arange(len(weights)), levels + 1)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels + 1) - (levels + 1), levels + 1)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    length = np.where(level == 0, 1.0, low)
    seed = mix64(shingles[element] ^ (level.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    weight, text = weights[element], of[element]
    time = np.zeros(len(element))
    step = 0
    while len(element):
        with np.errstate(over="ignore"):
            draw = mix64(seed + _STEP * np.uint64(2 * step))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53) / (components * length)
        component = ((draw & np.uint64(0x7FF)) * np.uint64(0x100000001) + (mix64(draw) >> np.uint64(32))) % np.uint64(components)
        counted = np.ones(len(element), dtype=bool)
        partial = np.flatnonzero(low + length > weight)
        if len(partial):
            with np.errstate(over="ignore"):
                place = mix64(seed[partial] + _STEP * np.uint64(2 * step + 1))
            counted[partial] = low[partial] + (place >> np.uint64(11)).astype(np.float64) / 2.0 ** 53 * length[partial] < weight[partial]
        np.minimum.at(first, (text * components + component.astype(np.int64))[counted], time[counted])
        last = first.reshape(n_texts, components).max(axis=1)
        go = np.flatnonzero(time < last[text])
        element, seed, weight, text, time, low, length = (x[go] for x in (element, seed, weight, text, time, low, length))
        step += 1
    return first.reshape(n_texts, components)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each text and band."""
    values = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    keys = mix64(np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signature), bands)))
    for r in range(rows):
        keys = mix64(keys ^ values[:, :, r])
    return keys.view(np.int64)


def occurrences(bag: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bags as sets: the k-th occurrence of a shingle is an element of
    its own, so the sets' Jaccard similarity is the bags' weighted one."""
    _, weights, _ = weigh(bag, counts)
    number = np.arange(len(bag)) - np.repeat(np.cumsum(weights) - weights, weights)
    return np.where(number == 0, bag, mix64(bag ^ mix64(number.astype(np.uint64)))).view(np.int64)


def bitmaps(elements: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bag :data:`BIT_WORDS` longs in which every element sets a
    bit; and the number of its elements less that of its bits."""
    places = (elements.view(np.uint64) % np.uint64(64 * BIT_WORDS)).astype(np.int64)
    bits = np.zeros((len(counts), 64 * BIT_WORDS), dtype=bool)
    bits[np.repeat(np.arange(len(counts)), counts), places] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64), counts - bits.sum(axis=1)


def _marked(batch: pa.RecordBatch):
    """``id``, ``mark`` and ``text`` of a bounded slice of rows at a time."""
    let_go()
    ids, marks, texts = columns_of(batch, "id", "mark", "text")
    for at, some in by_slice(pa.array(np.arange(batch.num_rows)), texts, SIGN_BYTES):
        yield ids.take(at), marks.take(at), some


def signatures(rows: DataFrame, bands: int, band_rows: int) -> DataFrame:
    """From ``id``, ``mark``, ``text``: ``id``, ``mark``, ``digest`` of the
    bag, ``keys`` of the bands (none without words)."""
    kind = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def sign(batches):
        for batch in batches:
            for ids, marks, texts in _marked(batch):
                bag, counts = shingle_bags(texts)
                ends = np.cumsum(counts)
                digests = [hashlib.sha256(bag[e - c:e].tobytes()).digest() for c, e in zip(counts.tolist(), ends.tolist())]
                keys = band_keys(bag_min_hash(*weigh(bag, counts), len(counts), bands * band_rows), bands, band_rows)
                have = counts > 0
                offsets = pa.array(np.append(0, np.cumsum(have * bands)).astype(np.int32))
                yield record_batch(kind, [ids, marks, digests, pa.ListArray.from_arrays(offsets, pa.array(keys[have].reshape(-1)))])

    return rows.select("id", "mark", "text").mapInArrow(sign, "id long, mark long, digest binary, keys array<long>")


def bag_sets(rows: DataFrame) -> DataFrame:
    """From ``id``, ``mark``, ``text``: ``id`` (both), ``bag``, the elements
    to verify with, ``brief``, 32 bits of each, and ``bits`` and ``spare`` of
    :func:`bitmaps`."""
    kind = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("bag", pa.list_(pa.int64())), ("brief", pa.list_(pa.int32())),
                      ("bits", pa.list_(pa.int64())), ("spare", pa.int32())])

    def bags(batches):
        for batch in batches:
            for ids, marks, texts in _marked(batch):
                bag, counts = shingle_bags(texts)
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                elements = occurrences(bag, counts)
                bits, spare = bitmaps(elements, counts)
                yield record_batch(kind, [ids, marks, pa.ListArray.from_arrays(offsets, pa.array(elements)),
                                          pa.ListArray.from_arrays(offsets, pa.array(elements.astype(np.int32))),
                                          pa.ListArray.from_arrays(np.arange(0, bits.size + 1, BIT_WORDS, dtype=np.int32), pa.array(bits.reshape(-1))), spare])

    found = rows.select("id", "mark", "text").mapInArrow(bags, "id long, mark long, bag array<long>, brief array<int>, bits array<long>, spare int")
    return found.select(document().alias("id"), "bag", "brief", "bits", "spare")


# --- classes ------------------------------------------------------------------

def row_key(id_column: str, text: Column) -> Column:
    """The id, or a number below any id from the text's hash if it is NULL."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID) - F.pmod(F.xxhash64(text), F.lit(1 << 61)))


def mark_of(text: Column) -> Column:
    """What tells the texts of one id apart; not the hash in :func:`row_key`."""
    return F.xxhash64(F.lit(1), text)


def document() -> Column:
    """A row's id with the mark of its text, in order of the ids."""
    return F.struct("id", "mark")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least node of its component) for the nodes of
    undirected ``edges`` (a, b): nodes are hooked to the least neighbour of
    their neighbourhood until every edge points at a root. Each star is
    written, so that a plan holds one of them and the driver little."""
    pairs = written(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).filter("node <> root").distinct(), "cc")
    while True:
        # Large star: each neighbour above a node hangs on the least of its neighbourhood.
        both = pairs.union(pairs.select(F.col("root").alias("node"), F.col("node").alias("root")))
        n_rows = 2 * pairs.count()
        lower = written(_with_least(both, n_rows).filter(F.col("root") > F.col("node"))
                        .select(F.col("root").alias("node"), F.least("node", "least").alias("root")), "cc-large")  # a row for each pair at most
        # Small star: the neighbours below a node, and itself, hang on the least of them.
        hung = F.array(F.struct("node", F.col("least").alias("root")), F.struct(F.col("root").alias("node"), F.col("least").alias("root")))
        after = written(_with_least(lower, n_rows).select(F.inline(hung)).filter(F.col("node") > F.col("root")).distinct(), "cc")
        # Done when every node has one root and no root is a node itself.
        ends = (after.select(F.col("node").alias("of"), F.lit(1).alias("below"), F.lit(0).alias("above"))
                .union(after.select(F.col("root"), F.lit(0), F.lit(1))))
        if ends.groupBy("of").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 or (below = 1 and above = 1)").isEmpty():
            return after
        pairs = after


def _with_least(edges: DataFrame, n_rows: int) -> DataFrame:
    """The ``edges`` (node, root), at most ``n_rows``, with the ``least`` root
    of their node. It is broadcast while there are few rows. Else hubs, nodes of
    more rows than a share of an average task, are at most ``tasks * PIECES``:
    their least is broadcast, and their rows are dealt by both ends."""
    if n_rows <= BROADCAST_ROOTS:
        least = edges.groupBy("node").agg(F.min("root").alias("least")).withColumnRenamed("node", "of")
        return edges.join(F.broadcast(least), F.col("node") == F.col("of")).select("node", "root", "least")
    piece = max(1, -(-n_rows // (int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) * PIECES)))
    hubs = (edges.groupBy("node").agg(F.min("root").alias("hub_least"), F.count("*").alias("n")).filter(F.col("n") > piece)
            .select(F.col("node").alias("hub"), "hub_least"))
    dealt = Window.partitionBy("node", F.when(F.col("hub").isNotNull(), F.col("root")))
    met = edges.join(F.broadcast(hubs), F.col("node") == F.col("hub"), "left")
    return met.select("node", "root", F.coalesce("hub_least", F.min("root").over(dealt)).alias("least"))


def near_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD,
                 bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``key`` (the id, or what takes
    its place) and ``class_id``, the least key of its class (or what takes its
    place if the class of another text of that id has it)."""
    signed, reps = _rooted(docs, id_column, text_column, threshold, bands, band_rows)
    class_id = F.col("root.id")
    repeated = written(signed.groupBy("id").agg(F.min("mark").alias("l"), F.max("mark").alias("h")).filter("l < h").select(F.col("id").alias("of")), "near-repeated")
    if not repeated.isEmpty():
        roots = reps.select(F.col("root.id").alias("root_id"), F.col("root.mark").alias("root_mark"))
        least = (roots.join(repeated, F.col("root_id") == F.col("of"), "left_semi")
                 .groupBy("root_id").agg(F.min("root_mark").alias("first_mark")).withColumnRenamed("root_id", "of"))
        reps = reps.join(least, F.col("root.id") == F.col("of"), "left")
        class_id = F.when(F.col("root.mark") > F.col("first_mark"), F.lit(2 * NO_ID) + F.pmod(F.col("root.mark"), F.lit(1 << 61))).otherwise(class_id)
    return (signed.select("id", "digest").join(reps.select("digest", class_id.alias("class_id")), "digest")
            .select(F.when(F.col("id") > NO_ID, F.col("id")).alias("doc_id"), F.col("id").alias("key"), "class_id"))


def _rooted(docs: DataFrame, id_column: str, text_column: str, threshold: float = THRESHOLD, bands: int = BANDS,
            band_rows: int = BAND_ROWS) -> tuple[DataFrame, DataFrame]:
    """The signatures of the rows; and ``digest``, ``root``: for each bag the
    least document of its class."""
    text = text_of(text_column)
    rows = docs.select(row_key(id_column, text).alias("id"), mark_of(text).alias("mark"), text.alias("text"))
    signed = written(signatures(rows, bands, band_rows), "near-signatures")
    classes = signed.groupBy("digest").agg(F.min(document()).alias("rep"), F.first("keys").alias("keys"))
    buckets = _shared_buckets(classes)
    # The documents in shared buckets; their ids are broadcast while they are few.
    wanted = checked_broadcast(buckets.select(F.col("rep.id").alias("rep_id"), F.col("rep.mark").alias("rep_mark")).distinct(), BROADCAST_IDS)
    # One row for each document, also if it is repeated.
    texts = rows.join(wanted, (F.col("id") == F.col("rep_id")) & (F.col("mark") == F.col("rep_mark")), "left_semi").dropDuplicates(["id", "mark"])
    bags = written(bag_sets(texts), "near-bags")

    # The first pivot of each bucket, compared with all its members.
    central = F.min(F.struct((-F.col("degree")).alias("less"), "rep")).alias("p")
    first = buckets.groupBy("bucket").agg(central).select(F.col("bucket").alias("p_bucket"), F.col("p.rep").alias("pivot"))
    met = written(buckets.join(first, F.col("bucket") == F.col("p_bucket")).filter("rep <> pivot")
                  .select("bucket", "rep", "degree", "pivot"), "near-first")
    links = _verified(met.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct(), bags, threshold)
    labels = components(links)
    mixed = _mixed(met.select("bucket", "rep", "degree"), labels)
    if not mixed.isEmpty():
        found = _exact(_near_pairs(mixed, signed, bags, threshold, bands), bags, threshold)
        if not found.isEmpty():
            labels = components(links.union(found))

    return signed, (classes.select("digest", "rep").join(labels, F.col("rep") == F.col("node"), "left")
                    .select("digest", F.coalesce("root", "rep").alias("root")))


def _shared_buckets(classes: DataFrame) -> DataFrame:
    """``bucket``, ``rep``, ``degree`` for the buckets with several members;
    the degree of a member is the size of all its buckets."""
    members = classes.select("rep", F.explode("keys").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("bucket", "shared")
    rows = written(members.join(shared, F.col("bucket") == F.col("shared")).select("bucket", "rep", "n"), "near-members")
    degrees = rows.groupBy("rep").agg(F.sum("n").alias("degree")).withColumnRenamed("rep", "of")
    return written(rows.join(degrees, F.col("rep") == F.col("of")).select("bucket", "rep", "degree"), "near-buckets")


def _compared(pairs: DataFrame, bags: DataFrame, column: str) -> DataFrame:
    """Pairs ``a``, ``b`` with the ``common`` elements of their bags and the
    sum of their ``sizes``."""
    a = bags.select(F.col("id").alias("a_id"), F.col(column).alias("a_bag"))
    b = bags.select(F.col("id").alias("b_id"), F.col(column).alias("b_bag"))
    both = pairs.join(b, F.col("b") == F.col("b_id")).join(a, F.col("a") == F.col("a_id"))
    return both.select("a", "b", F.size(F.array_intersect("a_bag", "b_bag")).alias("common"), (F.size("a_bag") + F.size("b_bag")).alias("sizes"))


def _reach(common: Column, sizes: Column, threshold: float) -> Column:
    return common >= threshold * (sizes - common)


def _reached(most: Column, sizes: Column, threshold: float) -> Column:
    """Whether so much in common may reach the threshold: ``most`` stands
    once, as it is dear, and rounding errs on the side of a look."""
    return most * (1 + threshold) >= threshold * sizes - 1e-6


def _slack(sizes: Column) -> Column:
    return F.lit(SLACK) + sizes.cast("double") * sizes / SLACK_SQUARE


def _exact(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs whose exact multiset overlap reaches the threshold."""
    common, sizes = F.col("common"), F.col("sizes")
    return written(_compared(pairs, bags, "bag").filter(_reach(common, sizes, threshold)).select("a", "b"), "near-links")


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The same from the brief bags, half as large; the few pairs so near the
    threshold that these can't tell are compared in full."""
    common, sizes = F.col("common"), F.col("sizes")
    near = written(_compared(pairs, bags, "brief").filter(_reach(common + _slack(sizes), sizes, threshold))
                   .select("a", "b", _reach(common - _slack(sizes), sizes, threshold).alias("sure")), "near-verified")
    return near.filter("sure").select("a", "b").union(_exact(near.filter("not sure").select("a", "b"), bags, threshold))


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the buckets that still join several components, with the
    component of each, and whether it is that of the bucket's middle."""
    labelled = (rows.join(labels, F.col("rep") == F.col("node"), "left")
                .select("bucket", "rep", "degree", F.coalesce("root", "rep").alias("label")))
    several = (labelled.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.max_by("label", "degree").alias("middle"))
               .filter("l < h").select(F.col("bucket").alias("of"), "middle"))
    return written(labelled.join(several, F.col("bucket") == F.col("of")).select("bucket", "rep", "label", (F.col("label") == F.col("middle")).alias("main")), "near-mixed")


def _near_pairs(mixed: DataFrame, signed: DataFrame, bags: DataFrame, threshold: float, bands: int) -> DataFrame:
    """Pairs of members of one bucket and different components, one of them
    outside the main one, that reach the threshold by their brief bags. Most
    other pairs end at the bitmaps or at a key that both have in an earlier
    band: plain columns, compared without a look into the bags."""
    reps = mixed.select("rep").distinct()
    about = (reps.join(signed.select(document().alias("id"), "keys").dropDuplicates(["id"]), F.col("rep") == F.col("id")).drop("id")
             .join(bags.select("id", "brief", "bits", "spare"), F.col("rep") == F.col("id")).drop("id").withColumnRenamed("rep", "of"))
    place = F.array_position("keys", F.col("bucket")) - 1
    earlier = [F.when(F.lit(i) < place, F.col("keys")[i]).alias(f"key{i}") for i in range(bands - 1)]
    words = [F.col("bits")[i].alias(f"bits{i}") for i in range(BIT_WORDS)]
    rows = written(mixed.join(about, F.col("rep") == F.col("of"))
                   .select("bucket", "rep", "label", "main", "brief", F.size("brief").alias("size"), "spare", *words, *earlier), "near-beside")
    outside = rows.filter(~F.col("main"))
    n, elements = outside.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # Few of them: the others are met where they lie, in a file of mixed buckets.
    outside = F.broadcast(outside) if 4 * elements + 8 * n * (BIT_WORDS + bands + 16) <= BROADCAST_BYTES else outside
    x, y = rows.alias("x"), outside.alias("y")
    sizes = F.col("x.size") + F.col("y.size")
    most = F.least("x.spare", "y.spare")
    for i in range(BIT_WORDS):
        most = most + F.bit_count(F.col(f"x.bits{i}").bitwiseAND(F.col(f"y.bits{i}")))
    before = F.lit(False)
    for i in range(bands - 1):
        before = before | (F.col(f"x.key{i}") == F.col(f"y.key{i}"))  # NULL from the bucket's band on
    common = F.size(F.array_intersect("x.brief", "y.brief")) + _slack(sizes)
    met = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label"))
                 & (F.col("x.main") | (F.col("x.rep") < F.col("y.rep")))
                 & (F.least("x.size", "y.size") >= threshold * F.greatest("x.size", "y.size"))
                 & _reached(most, sizes, threshold)
                 & ~F.coalesce(before, F.lit(False))
                 & _reached(common, sizes, threshold))
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, the one of the least id. Of
    rows that share its id and text, the one whose other columns have the
    least hash stays, the same in every run."""
    _, reps = _rooted(docs, id_column, text_column, **options)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    text = text_of(names[docs.columns.index(text_column)])
    kept = reps.select(F.col("root.id").alias("kept_id"), F.col("root.mark").alias("kept_mark")).distinct()
    rows = rows.withColumns({"row_id": row_key(names[docs.columns.index(id_column)], text), "row_mark": mark_of(text)})
    hashed = F.xxhash64(*[F.to_json(F.struct(n)) if isinstance(f.dataType, MapType) else F.col(n) for n, f in zip(names, docs.schema.fields)])
    one = (rows.join(kept, (F.col("row_id") == F.col("kept_id")) & (F.col("row_mark") == F.col("kept_mark")), "left_semi")
           .groupBy("row_id", "row_mark").agg(F.min_by(F.struct(*names), hashed).alias("row")))
    return one.select(*[F.col(f"row.{n}") for n in names]).toDF(*docs.columns)
