"""Token ids in binary files of patched frame-of-reference blocks.

The ids of all documents, each with an end id, form one sequence in
ascending document order. It is cut into blocks of 128 ids. A block stores
its minimum, the differences to it at one bit width, and the differences
that don't fit in a list of exceptions; the width is the one of a few
percentiles of the block's differences that takes the fewest bytes.

File layout (little-endian). A file is a run of segments, each of whole
documents; a segment is::

    magic "PFR1" | u32 documents | u64 ids | u32 blocks | u32 exceptions
    | u64 packed bytes
    i64 document ids | u8 1 where the document id is NULL | u64 ids per document
    u64 start of each block in the packed bytes     (the block index)
    u32 minimum | u8 width | u32 first exception    of each block
    packed bytes | u8 place | u32 difference of each exception | one newline

Spark's own writers put the files into place, so they land whole on any
store and a lost task is simply run again.

Edge cases: a NULL or empty text is a document of the end id alone; NULL
document ids come first; equal document ids follow one another in order of
text; no documents give an empty folder.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farepath.llm.common import by_slice, columns_of, kept, record_batch, small_batches, text_of
from farepath.session import ensure_checkpoint_dir

MAGIC = b"PFR1"
BLOCK = 128
#: Percentiles of a block's differences whose width is tried.
PERCENTILES = (90, 95, 98, 100)
#: Ids after which a segment ends.
SEGMENT_IDS = 1_000_000
#: Words that the memo of a task's encoder holds at most, and their bytes with those of their ids.
MEMO_WORDS, MEMO_BYTES = 150_000, 24_000_000
#: Characters of text in one file, about.
FILE_CHARS = 16_000_000

_HEADER = struct.Struct("<4sIQIIQ")
_EXCEPTION_BYTES = 5


# --- blocks -----------------------------------------------------------------

def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of each value below 2**32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values below 2**width as rows of 16 * width bytes."""
    words = np.zeros((2 * width, len(values)), dtype=np.uint64)
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        words[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(packed.view(np.uint64).T)
    out = np.empty((BLOCK, words.shape[1]), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[word + 1] << np.uint64(64 - shift))
        out[i] = value & mask
    return out.T


def encode_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment of the file. ``ids`` (uint32) holds the ids of all its
    documents one after the other, ``lengths`` how many belong to each."""
    n_blocks = -(-len(ids) // BLOCK)
    rows = np.empty(n_blocks * BLOCK, dtype=np.uint32)
    rows[:len(ids)] = ids
    if n_blocks:
        rows[len(ids):] = ids[-1]
    rows = rows.reshape(n_blocks, BLOCK)
    minimum = rows.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    rows = rows - minimum[:, None]
    ordered = np.sort(rows, axis=1)
    best = np.full(n_blocks, np.iinfo(np.int64).max)
    width = np.zeros(n_blocks, dtype=np.uint8)
    for p in PERCENTILES:
        w = _bits(ordered[:, -(-p * BLOCK // 100) - 1])
        exceptions = (rows >> np.uint32(1) >> (np.maximum(w, 1)[:, None] - 1).astype(np.uint32) != 0)
        count = np.where(w == 0, (rows != 0).sum(axis=1), exceptions.sum(axis=1))
        size = w.astype(np.int64) * (BLOCK // 8) + count * _EXCEPTION_BYTES
        width = np.where(size < best, w, width)
        best = np.minimum(best, size)
    low = ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    patched = rows > low[:, None]
    block_of, place = np.nonzero(patched)
    values = rows[block_of, place]
    rows = np.where(patched, np.uint32(0), rows)
    starts = np.zeros(n_blocks, dtype=np.uint64)
    starts[1:] = np.cumsum(width.astype(np.uint64) * np.uint64(BLOCK // 8))[:-1]
    packed = np.empty(int(width.astype(np.int64).sum()) * (BLOCK // 8), dtype=np.uint8)
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            at = starts[which].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 8))
            packed[at] = _pack(rows[which], int(w))
    first = np.searchsorted(block_of, np.arange(n_blocks)).astype(np.uint32)
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], dtype=np.int64)
    return b"".join((
        _HEADER.pack(MAGIC, len(doc_ids), len(ids), n_blocks, len(values), len(packed)),
        known.tobytes(), null.tobytes(), np.asarray(lengths, dtype=np.uint64).tobytes(),
        starts.tobytes(), minimum.astype(np.uint32).tobytes(), width.astype(np.uint8).tobytes(), first.tobytes(),
        packed.tobytes(), place.astype(np.uint8).tobytes(), values.astype(np.uint32).tobytes()))


def _decode_blocks(minimum, width, starts, packed, block_of, place, values) -> np.ndarray:
    out = np.zeros((len(minimum), BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            at = starts[which].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 8))
            out[which] = _unpack(packed[at], int(w))
    out[block_of, place] = values
    return (out + minimum[:, None]).reshape(-1)


class Segment:
    """One segment of a file, read lazily: the whole of it, or any range of
    ids through the block index."""

    def __init__(self, data: memoryview, at: int = 0):
        magic, self.n_docs, self.n_ids, self.n_blocks, self.n_exceptions, self.n_packed = _HEADER.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        self._data, self._at = data, at + _HEADER.size
        known, null = self._take(np.int64, self.n_docs), self._take(np.uint8, self.n_docs)
        self.doc_ids = [None if n else int(d) for d, n in zip(known, null)]
        self.lengths = self._take(np.uint64, self.n_docs).astype(np.int64)
        self.starts = self._take(np.uint64, self.n_blocks)
        self.minimum = self._take(np.uint32, self.n_blocks)
        self.width = self._take(np.uint8, self.n_blocks)
        self.first = self._take(np.uint32, self.n_blocks)
        self.packed = self._take(np.uint8, self.n_packed)
        self.place = self._take(np.uint8, self.n_exceptions)
        self.values = self._take(np.uint32, self.n_exceptions)
        self.end = self._at + 1

    def _take(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, dtype=kind, count=n, offset=self._at)
        self._at += out.nbytes
        return out

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        a, b = start // BLOCK, -(-stop // BLOCK)
        ends = np.append(self.first, self.n_exceptions).astype(np.int64)
        lo, hi = ends[a], ends[b]
        block_of = np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))
        rows = _decode_blocks(self.minimum[a:b], self.width[a:b], self.starts[a:b], self.packed,
                              block_of, self.place[lo:hi], self.values[lo:hi])
        return rows[start - a * BLOCK:stop - a * BLOCK]


def segments(content: bytes) -> Iterator[Segment]:
    view, at = memoryview(content), 0
    while at < len(view):
        segment = Segment(view, at)
        yield segment
        at = segment.end


# --- tokenizer --------------------------------------------------------------

class WordwiseEncoder:
    """Ids of whole texts under a lower-casing word BPE of the tokenizers
    library, with a memo of the ids of each word.

    The tokenizer splits a text into runs of letters, single digits and runs
    of other marks before it merges, and no merge spans two of them. Over
    Latin-1, where lower-casing and that split are plain, they are done here,
    and only words not in the memo go to the tokenizer's model, joined by
    spaces: the end-of-word ids tell them apart again. Chunks with other
    characters, and texts that spell a special token, go to the whole
    tokenizer.
    """

    #: The tokenizer's own split, spelt out for U+0000..U+00FF.
    _LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
    _SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")

    #: Letters with marks behind them (no apostrophe): one word and one run of marks.
    _PLAIN = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!\"#$%&()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]*)$"

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._merges = Tokenizer(self._tokenizer.model)
        self._merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        byte_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._letters: dict[int, str] = {}  # the model's letter for each byte of UTF-8 up to U+07FF
        for char in map(chr, range(0x800)):
            self._letters.update(zip(char.encode(), byte_letters.pre_tokenize_str(char)[0][0]))
        suffix = self._tokenizer.model.end_of_word_suffix
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self._tokenizer.get_vocab().items():
            self._ends[i] = token.endswith(suffix)
        self._memo = pa.array([""], pa.string()), pa.array([b""], pa.large_binary())

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of lower-case Latin-1 words, none of them empty."""
        out = []
        for lo in range(0, len(words), 500):
            some = words[lo:lo + 500]
            spelt = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self._letters) for w in some]
            ids = np.array(self._merges.encode_batch_fast([" ".join(spelt)], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, ends = ids.tobytes(), ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()
            if len(ends) != len(some):  # a word whose ids hold an end inside: one by one
                out += self._whole(some)
            else:
                out += map(raw.__getitem__, map(slice, [0, *ends], ends))
        return out

    def _known(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of distinct lower-case words of Latin-1 letters, or of marks.
        Arrow looks them up in the memo, which holds words and ids side by side."""
        words_held, ids_held = self._memo
        at = pc.index_in(words, value_set=words_held)
        missing = words.filter(pc.is_null(at))
        if len(missing):
            words_held = pa.concat_arrays([words_held, missing])
            ids_held = pa.concat_arrays([ids_held, pa.array(self._words(missing.to_pylist()), pa.large_binary())])
            self._memo = words_held, ids_held
        place = np.array(pc.fill_null(at, -1))
        place[place < 0] = np.arange(len(words_held) - len(missing), len(words_held))
        return ids_held.take(pa.array(place))

    def _bound_memo(self, words: pa.StringArray, ids: pa.LargeBinaryArray) -> None:
        """Once the memo is full, only these words stay in it, the last asked for."""
        if len(self._memo[0]) > MEMO_WORDS or sum(x.nbytes for x in self._memo) > MEMO_BYTES:
            self._memo = pa.concat_arrays([pa.array([""], pa.string()), words]), pa.concat_arrays([pa.array([b""], pa.large_binary()), ids])

    def _others(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks of any other form."""
        pieces, whole = {}, []
        for c in chunks:
            if _latin(c):
                pieces[c] = self._SPLIT.findall(c.lower())
            else:
                whole.append(c)
        words = list({w for p in pieces.values() for w in p})
        known = dict(zip(words, self._known(pa.array(words, pa.string())).to_pylist()))
        found = dict(zip(whole, self._whole(whole)))
        found.update((c, b"".join(map(known.__getitem__, p))) for c, p in pieces.items())
        return [found[c] for c in chunks]

    def encode_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of the texts one after the other, and how many
        belong to each. Arrow splits the texts into chunks, finds the distinct
        ones and parts them into letters and the marks behind; each distinct
        word is looked up once, and Arrow joins and gathers the ids as bytes."""
        if any(pc.any(pc.match_substring(texts, s)).as_py() for s in self._special):
            found = [self._whole([t])[0] if any(s in t for s in self._special) else self.encode_all(pa.array([t], pa.string()))[0].tobytes()
                     for t in texts.to_pylist()]
            return np.frombuffer(b"".join(found), dtype="<u4"), np.array([len(x) // 4 for x in found], dtype=np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary
        parts = pc.extract_regex(chunks, self._PLAIN)
        plain = pc.is_valid(parts)
        letters = pc.utf8_lower(pc.fill_null(pc.struct_field(parts, "letters"), "")).dictionary_encode()
        marks = pc.fill_null(pc.struct_field(parts, "marks"), "").dictionary_encode()
        # The ids of a chunk as bytes: those of its letters, then those of its marks.
        spelt = [self._known(p.dictionary) for p in (letters, marks)]
        known = pc.binary_join_element_wise(spelt[0].take(letters.indices), spelt[1].take(marks.indices), pa.scalar(b"", pa.large_binary()))
        if not pc.all(plain).as_py():
            others = self._others(chunks.filter(pc.invert(plain)).to_pylist())
            known = pc.replace_with_mask(known, pc.invert(plain), pa.array(others, pa.large_binary()))
        self._bound_memo(letters.dictionary, spelt[0])
        gathered = known.take(coded.indices)
        offsets = np.frombuffer(gathered.buffers()[1], dtype=np.int64)[gathered.offset:gathered.offset + len(gathered) + 1]
        ids = np.frombuffer(gathered.buffers()[2] or b"", dtype="<u4", offset=int(offsets[0]), count=int(offsets[-1] - offsets[0]) // 4)
        ends = (offsets[np.cumsum(pc.list_value_length(lists).to_numpy())] - offsets[0]) // 4
        return ids, np.diff(ends, prepend=0)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _encoder(path: str) -> WordwiseEncoder:
    """One per Python worker, so that its memo serves later tasks too."""
    return kept(("encoder", path), lambda: WordwiseEncoder(path))


# --- Spark ------------------------------------------------------------------

def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_column: str = "doc_id",
                      text_column: str = "text", file_chars: int = FILE_CHARS) -> None:
    """Encode every text and write the files of ids under ``path``, in
    ascending order of the ids of the documents from file to file."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def encode(batches):
        encoder = _encoder(tokenizer_path)
        kind = pa.schema([("value", pa.binary())])
        ids, lengths, doc_ids = [], [], []

        def segment():
            return record_batch(kind, [[encode_segment(doc_ids, np.concatenate(lengths), np.concatenate(ids))]])

        for batch in batches:
            for keys, texts in by_slice(*columns_of(batch, "id", "text")):
                found, counts = encoder.encode_all(texts)
                ids.append(np.insert(found, np.cumsum(counts), end_id))
                lengths.append(counts + 1)
                doc_ids += keys.to_pylist()
                if sum(map(len, ids)) >= SEGMENT_IDS:
                    yield segment()
                    ids, lengths, doc_ids = [], [], []
                    pa.default_memory_pool().release_unused()
        if doc_ids:
            yield segment()

    encoded = (rows.repartitionByRange(max(1, -(-chars // file_chars)), "id").sortWithinPartitions("id", "text")
               .mapInArrow(encode, "value binary")
               .select(F.col("value").cast("string")))  # the bytes as they are; the writer adds the newline
    with small_batches(docs.sparkSession):
        encoded.write.option("lineSep", "\n").text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id``, ``file_no``, ``file_start`` (ids
    before it in its file), ``n_tokens``, ``ids_crc32`` of the decoded ids."""
    kind = pa.schema([("doc_id", pa.int64()), ("file_no", pa.int64()), ("file_start", pa.int64()),
                      ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        for batch in batches:
            for number, content in zip(*(c for c in columns_of(batch, "file_no", "content"))):
                at = 0
                for segment in segments(content.as_buffer()):
                    raw = memoryview(segment.ids().astype("<u4").tobytes())
                    ends = np.cumsum(segment.lengths)
                    starts = ends - segment.lengths
                    sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    yield record_batch(kind, [segment.doc_ids, np.full(len(starts), number.as_py()),
                                              starts + at, segment.lengths, sums])
                    at += segment.n_ids

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("long")
    return (files.select(number.alias("file_no"), "content")
            .mapInArrow(decode, "doc_id long, file_no long, file_start long, n_tokens long, ids_crc32 long"))


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids themselves: ``doc_id``, ``ids`` (array of long)."""
    def decode(batches):
        for batch in batches:
            for content in columns_of(batch, "content")[0]:
                for segment in segments(content.as_buffer()):
                    offsets = np.append(0, np.cumsum(segment.lengths)).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(segment.ids().astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(segment.doc_ids, pa.int64()), ids], ["doc_id", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(decode, "doc_id long, ids array<long>")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens``, ``ids_crc32``, all read from the files."""
    from pyspark.sql import Window

    ensure_checkpoint_dir(spark)
    docs = read_token_files(spark, path).checkpoint()
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = (docs.groupBy("file_no").agg(F.sum("n_tokens").alias("file_ids"))  # one row a file
             .select("file_no", F.coalesce(F.sum("file_ids").over(before), F.lit(0)).alias("file_base")))
    return (docs.join(files, "file_no")
            .select("doc_id", (F.col("file_base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32"))

