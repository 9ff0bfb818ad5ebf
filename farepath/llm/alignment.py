"""Alignment of two tokenizers' tokens over the same bytes.

Each text, with a space in front, is encoded by a byte-level BPE file (A) and
by a sentencepiece BPE model (B); a token's place is where its bytes end.
Both ends are sorted sequences, so their merge tells everything: every
different end closes one overlap of an A token with a B token (a link), and
where tokens of both sides end, a group ends.

*Merge path.* The merge of two sorted sequences is a path through their grid.
A binary search along each of a set of evenly spaced diagonals finds where
the path crosses it, for all of them at once. Between two diagonals lies a
piece of equal work that needs nothing of the others: it emits its overlaps
and the ends that both sides share in it. Only an end that both share may lie
on a border, A's in one piece and B's in the next; there the pieces are
stitched, so that the group ends and the overlap counts once.

*Segments.* Neither tokenizer merges across a space that follows a character
other than white space, so texts are cut there, and within a bounded slice of
texts each different segment is encoded and aligned once. A text's tokens,
groups and links are those of its segments in order. A long unbroken text is
one segment, cut into pieces by the merge path alone.

*Counts.* A table keeps, per text, its different id pairs and how often each
is linked. Pairs are counted over the corpus (partial sums first), the
highest count of each A id is found, and the counts return to the texts by a
join: a broadcast one while the pairs are few (a checked number), otherwise a
shuffled one.

Edge cases: NULL and empty texts, and texts whose tokens' bytes differ from
the text (one that holds U+2581, say), have no tokens: zeros and an empty
``groups_sha256``. Rows are kept apart whatever their ids are; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farepath.llm.common import by_slice, columns_of, record_batch, small_batches, text_of
from farepath.session import new_scratch_path

#: Ends of both sides in one piece of the merge.
PIECE_WORK = 65_536
#: Bytes of text that are aligned at once.
SLICE_BYTES = 2_000_000
#: Segments that are encoded or written out as text at once.
SOME = 50_000
#: Most id pairs that are broadcast; beyond, they are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
SPACE_MARK = "▁"
#: A last character that any tokenizer may take for white space.
_SPACE_AT_END = r"[\s\pZ\x{85}\x{1c}-\x{1f}\x{180e}\x{200b}]\z|^\z"
#: Segments of these characters only, up to so many bytes, go to the faster
#: encoder: any Unicode version splits them alike, and none is a long run.
_PLAIN, PLAIN_BYTES = r"^[\x00-\x{24f}]*\z", 4000


def merge_path(a: np.ndarray, b: np.ndarray, work: int = PIECE_WORK) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` lie before each piece border, from 0 to
    all; of equal ends that of ``a`` comes first."""
    diagonals = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(low), dtype=bool)
        first[open_] = a[middle[open_]] <= b[(diagonals - middle - 1)[open_]]
        low = np.where(open_ & first, middle + 1, low)
        high = np.where(open_ & ~first, middle, high)
    return low, diagonals - low


def piece_overlaps(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One piece by itself: ``a`` and ``b`` are its ends, ``i`` and ``j`` how
    many come before. In order of ends: the A and the B token that overlap up
    to each, and whether both end there."""
    before = np.searchsorted(b, a)  # B ends below each A end
    shared = np.zeros(len(a), dtype=bool)
    inside = before < len(b)
    shared[inside] = b[before[inside]] == a[inside]
    own = np.ones(len(b), dtype=bool)
    own[before[shared]] = False
    own_at = np.flatnonzero(own)
    below = np.searchsorted(a, b[own_at])
    ends = np.append(a, b[own_at])
    order = np.argsort(ends, kind="stable")
    return (np.append(np.arange(len(a)), below)[order] + i, np.append(before, own_at)[order] + j,
            np.append(shared, np.zeros(len(own_at), dtype=bool))[order])


def overlaps(a: np.ndarray, b: np.ndarray, work: int = PIECE_WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps of two token sequences over the same bytes, given the
    ends: A index, B index, and whether a group ends with the overlap."""
    i, j = merge_path(a, b, work)
    pieces = []
    for k in range(len(i) - 1):
        piece = piece_overlaps(a[i[k]:i[k + 1]], b[j[k]:j[k + 1]], int(i[k]), int(j[k]))
        if pieces and i[k] and j[k] < j[k + 1] and a[i[k] - 1] == b[j[k]]:
            # The A end of a shared end closed the piece before: the group ends
            # there, and B's end is no overlap of its own.
            last = next(p for p in reversed(pieces) if len(p[2]))
            last[2][-1] = True
            piece = tuple(x[1:] for x in piece)
        pieces.append(piece)
    empty = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([p[n] for p in pieces] or [empty]) for n in range(3))


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(others)}


class ByteLevelTokens:
    """Token ids of a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = byte_level_bytes()
        vocabulary = {k: v for k, v in model["vocab"].items() if all(c in of for c in k)}
        self.bytes_of = {i: bytes(of[c] for c in token) for token, i in vocabulary.items()}
        self._quick = self._ranked(model, vocabulary)

    def _ranked(self, model: dict, vocabulary: dict[str, int]):
        """A faster encoder of the same vocabulary, where the file's merges
        come in order of ids, as that encoder's do."""
        import public_tokenizers
        import tiktoken
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if None in merged or merged != sorted(set(merged)):
            return None
        ranks = {self.bytes_of[i]: i for i in [*vocabulary.values()] if len(self.bytes_of[i]) == 1} | {self.bytes_of[i]: i for i in merged}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments one after the other, and how many each has."""
        found = [e.ids for e in self._tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        return _flat(found)

    def encode_plain(self, segments: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        if self._quick is None:
            return self.encode(segments.to_pylist())
        ids = np.array(self._quick.encode_ordinary("".join(segments.to_pylist())), dtype=np.int64)
        ends = np.cumsum(self.lengths[ids])
        upto = np.searchsorted(ends, np.cumsum(pc.binary_length(segments).to_numpy()), "right")
        return ids, np.diff(np.append(0, upto))

    @property
    def lengths(self) -> np.ndarray:
        return self.__dict__.setdefault("_lengths", _lengths(self.bytes_of))


class PieceTokens:
    """Token ids of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self._model = SentencePieceProcessor(model_file=path)
        self.bytes_of = {}
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            if self._model.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif self._model.is_control(i) or self._model.is_unknown(i):
                self.bytes_of[i] = b""
            else:
                self.bytes_of[i] = piece.replace(SPACE_MARK, " ").encode()
        self.size = self._model.get_piece_size()
        self.lengths = _lengths(self.bytes_of)
        self._mark = [self._model.piece_to_id(SPACE_MARK)]

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The model puts a space in front by itself, but not of nothing."""
        found = self._model.encode([s[1:] for s in segments], num_threads=1)
        return _flat([f if s != " " else self._mark for f, s in zip(found, segments)])


def _lengths(bytes_of: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(bytes_of) + 1, dtype=np.int64)
    for i, b in bytes_of.items():
        out[i] = len(b)
    return out


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(counts.sum())), counts


def segmented(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The different segments (each begins with a space), the segment at each
    place of the texts one after the other, and where each text's begin and
    end. Empty texts have none."""
    lists = pc.split_pattern(texts, " ")
    sizes = np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy())
    coded = pc.list_flatten(lists.filter(pa.array(sizes > 0))).dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    ends = np.append(0, np.cumsum(sizes))
    begins = np.ones(len(codes), dtype=bool)
    if len(codes):
        begins[1:] = ~pc.match_substring_regex(words, _SPACE_AT_END).to_numpy(zero_copy_only=False)[codes[:-1]]
        begins[ends[:-1][sizes > 0]] = True
    spaced = pc.binary_join_element_wise("", words, " ")
    if begins.all():
        return spaced, codes, ends
    # Words after white space other than a space, and runs of spaces.
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, len(codes)))
    several = lengths > 1
    inside = np.repeat(several, lengths)
    runs = pc.binary_join(pa.LargeListArray.from_arrays(np.append(0, np.cumsum(lengths[several])), words.take(pa.array(codes[inside]))), " ")
    runs = pc.binary_join_element_wise("", runs, " ").dictionary_encode()
    out = codes[starts].astype(np.int64)
    out[several] = len(words) + runs.indices.to_numpy()
    return pa.concat_arrays([spaced, runs.dictionary.cast(spaced.type)]), out, np.searchsorted(starts, ends)


class Aligner:
    """Aligns slices of texts; the encoders are kept by the Python worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevelTokens(a_path), PieceTokens(b_path)
        self._names = [pa.array([str(i) for i in range(len(side.lengths))]) for side in (self.a, self.b)]

    def _encoded(self, segments: pa.StringArray, plain: int):
        """Ids of both sides and how many each segment has, without those of
        segments whose bytes they don't give; and which segments these are."""
        sides = ([], [], []), ([], [], [])
        bad = np.zeros(len(segments), dtype=bool)
        for lo, hi in [(x, min(x + SOME, end)) for start, end in ((0, plain), (plain, len(segments))) for x in range(start, end, SOME)]:
            part = segments.slice(lo, hi - lo)
            texts = part.to_pylist()
            want = "".join(texts).encode()
            for side, (some_ids, some_counts, _), quick in ((self.a, sides[0], hi <= plain), (self.b, sides[1], False)):
                ids, counts = side.encode_plain(part) if quick else side.encode(texts)
                of = side.bytes_of
                if b"".join([of.get(i, b"") for i in ids.tolist()]) != want:
                    upto = np.append(0, np.cumsum(counts))
                    for k, text in enumerate(texts):
                        if b"".join([of.get(i, b"") for i in ids[upto[k]:upto[k + 1]].tolist()]) != text.encode():
                            bad[lo + k] = True
                some_ids.append(ids)
                some_counts.append(counts)
        out = []
        for some_ids, some_counts, _ in sides:
            ids, counts = (np.concatenate(x or [np.zeros(0, dtype=np.int64)]) for x in (some_ids, some_counts))
            out += [ids[np.repeat(~bad, counts)], np.where(bad, 0, counts)]
        return *out, bad

    def _groups(self, a_ids, b_ids, a_index, b_index, cut, group_counts) -> pa.StringArray:
        """Each segment's groups as text."""
        sides = [pc.binary_join(pa.LargeListArray.from_arrays(np.append(0, index[cut] + 1), names.take(pa.array(ids))), ",")
                 for ids, index, names in ((a_ids, a_index, self._names[0]), (b_ids, b_index, self._names[1]))]
        both = pc.binary_join_element_wise(*sides, "|")
        return pc.binary_join(pa.LargeListArray.from_arrays(np.append(0, np.cumsum(group_counts)), both), ";")

    def align(self, texts: pa.StringArray, work: int = PIECE_WORK) -> list:
        """Per text: counts of A and B tokens, groups and links, the digest of
        the groups, the different id pairs and how often each is linked."""
        segments, codes, ends = segmented(texts)
        quick = pc.match_substring_regex(segments, _PLAIN).to_numpy(zero_copy_only=False) & (pc.binary_length(segments).to_numpy() <= PLAIN_BYTES)
        order = np.argsort(~quick, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        segments, codes = segments.take(pa.array(order)), place[codes]
        a_ids, a_counts, b_ids, b_counts, bad = self._encoded(segments, int(quick.sum()))
        a_index, b_index, cut = overlaps(np.cumsum(self.a.lengths[a_ids]), np.cumsum(self.b.lengths[b_ids]), work)
        segment = np.repeat(np.arange(len(segments)), a_counts)[a_index]
        link_counts = np.bincount(segment, minlength=len(segments))
        group_counts = np.bincount(segment[cut], minlength=len(segments))
        groups = self._groups(a_ids, b_ids, a_index, b_index, cut, group_counts)

        n = len(texts)
        of_text = np.repeat(np.arange(n), np.diff(ends))
        failed = np.bincount(of_text, weights=bad[codes], minlength=n) > 0
        totals = [np.where(failed, 0, np.bincount(of_text, weights=x[codes], minlength=n)).astype(np.int64)
                  for x in (a_counts, b_counts, group_counts, link_counts)]
        digests = [self._digest(groups, codes[lo:hi]) if hi > lo and not f else "" for lo, hi, f in zip(ends[:-1].tolist(), ends[1:].tolist(), failed.tolist())]

        # Pairs: of each text's different segments first.
        pairs, pair_of = np.unique(a_ids[a_index] * self.b.size + b_ids[b_index], return_inverse=True)
        kept = ~failed[of_text]
        uses, times = np.unique(of_text[kept] * max(1, len(segments)) + codes[kept], return_counts=True)
        text, used = np.divmod(uses, max(1, len(segments)))
        many = link_counts[used]
        first = np.append(0, np.cumsum(link_counts))[:-1][used]
        at = np.repeat(first - np.append(0, np.cumsum(many))[:-1], many) + np.arange(int(many.sum()))
        keys, which = np.unique(np.repeat(text, many) * max(1, len(pairs)) + pair_of[at], return_inverse=True)
        linked = np.bincount(which, weights=np.repeat(times, many), minlength=len(keys)).astype(np.int64)
        upto = np.searchsorted(keys, np.arange(n + 1) * max(1, len(pairs)))
        lists = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(x, pa.int64())) for x in (pairs[keys % max(1, len(pairs))], linked)]
        return [*totals, digests, *lists]

    @staticmethod
    def _digest(groups: pa.StringArray, codes: np.ndarray) -> str:
        digest = hashlib.sha256()
        for lo in range(0, len(codes), SOME):
            digest.update(b";" * bool(lo))
            digest.update(";".join(groups.take(pa.array(codes[lo:lo + SOME])).to_pylist()).encode())
        return digest.hexdigest()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


_KIND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                   ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def alignments(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", work: int = PIECE_WORK) -> DataFrame:
    """The alignment of each text, written to the scratch folder: its counts
    and digest, and its ``pairs`` (A id times B's vocabulary size, plus B id)
    with the ``times`` each is linked. ``row`` tells rows apart."""

    def align(batches) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for ids, texts in by_slice(*columns_of(batch, "id", "text"), SLICE_BYTES):
                yield record_batch(_KIND, [np.arange(row, row + len(ids)), ids, *aligner.align(texts, work)])
                row += len(ids)

    found = (docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
             .mapInArrow(align, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"))
    path = new_scratch_path(docs.sparkSession, "alignments")
    with small_batches(docs.sparkSession):
        found.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """``pair``, ``texts`` (how many hold it) and ``best`` (as many as any
    pair of its A id), written to the scratch folder."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("texts"))
    spark = aligned.sparkSession
    path, ranked = new_scratch_path(spark, "pair-counts"), new_scratch_path(spark, "pair-best")
    counts.withColumn("a", F.expr(f"pair div {b_size}")).write.parquet(path)
    counts = spark.read.parquet(path)
    highest = counts.groupBy("a").agg(F.max("texts").alias("highest"))
    counts.join(highest, "a").select("pair", "texts", (F.col("texts") == F.col("highest")).alias("best")).write.parquet(ranked)
    return spark.read.parquet(ranked)


def align(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text",
          broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per row ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best`` (links whose pair is in as many texts as any of its A id),
    ``count_sum`` (over links, of their pair's count), ``groups_sha256``."""
    aligned = alignments(docs, a_path, b_path, id_column, text_column)
    counts = pair_counts(aligned, PieceTokens(b_path).size)
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    links = aligned.select("row", "times", F.posexplode("pairs").alias("k", "pair")).select("row", "pair", F.expr("times[k]").alias("n"))
    sums = (links.join(counts, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("texts")).alias("count_sum")))
    zero = F.lit(0).cast("long")
    return (aligned.drop("pairs", "times").join(sums, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                    F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"))
