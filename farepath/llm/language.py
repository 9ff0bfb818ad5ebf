"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of the
letter. An n-gram's vector binds (multiplies) the vectors of its letters,
each permuted (rotated) by its place; a text's vector bundles (adds) the
vectors of all its n-grams, a word boundary counting as one more letter. A
language's prototype bundles the unit vectors of a sample of its documents,
about :data:`PER_LANGUAGE` of them, and a document is of the language whose prototype has the largest
cosine with it.

All vectors come from hashes, so nothing but the prototypes (one vector a
language) has to be shared.

Edge cases: a NULL text or one without a letter is ``und`` with score 0;
ties go to the language first in code-point order; without any prototype
every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farepath.llm.common import columns_of, mix64, record_batch, slices, text_of

DIMENSIONS = 1024
GRAM = 3
#: Documents of each language that its prototype is bundled from.
PER_LANGUAGE = 1500
#: Characters of one text whose n-grams are laid out at once.
PART_CHARS = 1_000_000
UNKNOWN = "und"

_LETTERS: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((i if chr(i).isalpha() else 0 for i in range(0x110000)), dtype=np.uint32, count=0x110000)
    return _LETTERS


def letter_vectors(letters: np.ndarray, dimensions: int) -> np.ndarray:
    """Rows of +1 and -1 for code points, from a hash of each."""
    words = np.arange(-(-dimensions // 64), dtype=np.uint64)
    bits = mix64(mix64(letters.astype(np.uint64))[:, None] ^ (words[None, :] * np.uint64(0xD1342543DE82EF95)))
    return np.unpackbits(bits.view(np.uint8), axis=1)[:, :dimensions].astype(np.float32) * 2 - 1


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of n-grams, each a row of ``GRAM`` code points."""
    out = np.ones((len(grams), dimensions), dtype=np.float32)
    for place in range(GRAM):
        letters, of = np.unique(grams[:, place], return_inverse=True)
        out *= np.roll(letter_vectors(letters, dimensions), place, axis=1)[of]
    return out


def gram_counts(text: str, part_chars: int = PART_CHARS) -> tuple[np.ndarray, np.ndarray, bool]:
    """Distinct n-grams of a text (packed in 21 bits a letter), how often
    each occurs, and whether there is a letter at all. A long text is read in
    parts; what the next part's first n-grams begin with is carried over."""
    grams, counts, known = np.zeros(0, np.uint64), np.zeros(0, np.int64), False
    lowered = text.lower()
    end = np.zeros(1, dtype=np.uint64)
    before = end
    for at in range(0, len(lowered), part_chars):
        points = np.frombuffer(lowered[at:at + part_chars].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letters = _letter_table()[points]
        known = known or bool(letters.any())
        run = np.concatenate([before, letters, end if at + part_chars >= len(lowered) else end[:0]])
        run = run[np.append(True, (run[1:] != 0) | (run[:-1] != 0))]  # one mark between words
        n = max(0, len(run) - GRAM + 1)
        packed = np.zeros(n, dtype=np.uint64)
        for place in range(GRAM):
            packed = (packed << np.uint64(21)) | run[place:place + n]
        before = run[-(GRAM - 1):]
        found, often = np.unique(packed, return_counts=True)
        if len(grams):
            found, of = np.unique(np.concatenate([grams, found]), return_inverse=True)
            often = np.bincount(of, np.concatenate([counts, often]), len(found)).astype(np.int64)
        grams, counts = found, often
    return (grams, counts, True) if known else (grams[:0], counts[:0], False)


def document_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text, and which texts have a letter."""
    counted = [gram_counts(t) for t in texts]
    known = np.array([c[2] for c in counted], dtype=bool)
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    if not known.any():
        return out, known
    grams, of = np.unique(np.concatenate([c[0] for c in counted]), return_inverse=True)
    letters = np.stack([(grams >> np.uint64(21 * (GRAM - 1 - p))) & np.uint64((1 << 21) - 1) for p in range(GRAM)], axis=1)
    ends = np.cumsum([len(c[0]) for c in counted])
    counts = np.concatenate([c[1] for c in counted]).astype(np.float32)
    # The n-grams in blocks, so that their vectors take bounded room.
    order = np.argsort(of, kind="stable")
    rows = np.searchsorted(ends, np.arange(len(of)), side="right")
    for lo in range(0, len(grams), 4096):
        span = order[np.searchsorted(of[order], lo):np.searchsorted(of[order], lo + 4096)]
        block = np.zeros((len(texts), min(4096, len(grams) - lo)), dtype=np.float32)
        block[rows[span], of[span] - lo] = counts[span]
        out += block @ gram_vectors(letters[lo:lo + 4096], dimensions)
    return out, known


def learn_prototypes(docs: DataFrame, training: Column, lang_column: str = "lang", id_column: str = "doc_id",
                     text_column: str = "text", per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> dict[str, list[float]]:
    """Unit prototype of each language. About ``per_language`` documents of
    each are read, those whose id's hash is below that share of the language;
    Spark adds up their unit vectors. One count and one vector a language
    reach the driver."""
    rows = docs.filter(training & F.col(lang_column).isNotNull()).select(
        F.col(lang_column).alias("lang"), F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, per_language / n)])
    draw = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    sample = rows.filter(draw < share[F.col("lang")]).select("lang", "text")
    kind = pa.schema([("lang", pa.string()), ("place", pa.int32()), ("value", pa.float64())])

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = (c.to_pylist() for c in columns_of(batch, "lang", "text"))
            for lo, hi in slices(texts, 1_000_000):
                vectors, known = document_vectors(texts[lo:hi], dimensions)
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                for lang, vector, letter in zip(langs[lo:hi], vectors, known):
                    if letter:
                        sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        for lang, total in sums.items():
            yield record_batch(kind, [[lang] * dimensions, np.arange(dimensions, dtype=np.int32), np.round(total, 6)])

    added = (sample.mapInArrow(bundle, "lang string, place int, value double")
             .groupBy("lang", "place").agg(F.sum("value").alias("value"))
             .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("values")))  # one vector a language
    out = {}
    for row in added.collect():
        vector = np.array([v["value"] for v in row["values"]])
        out[row["lang"]] = (vector / max(np.linalg.norm(vector), 1e-9)).tolist()
    return out


def identify(docs: DataFrame, prototypes: dict[str, list[float]], id_column: str = "doc_id", text_column: str = "text",
             dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (the cosine, 0 if negative) per row."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], dtype=np.float32).reshape(len(names), dimensions).T
    kind = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def compare(batches):
        for batch in batches:
            ids, texts = columns_of(batch, "id", "text")
            texts = texts.to_pylist()
            for lo, hi in slices(texts, 1_000_000):
                vectors, known = document_vectors(texts[lo:hi], dimensions)
                if not names:
                    known[:] = False
                cosines = vectors @ matrix / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                best = cosines.argmax(axis=1) if names else np.zeros(hi - lo, dtype=int)
                langs = [names[b] if k else UNKNOWN for b, k in zip(best, known)]
                scores = [min(1.0, max(0.0, float(c[b]))) if k else 0.0 for c, b, k in zip(cosines, best, known)]
                yield record_batch(kind, [ids.slice(lo, hi - lo), langs, scores])

    return (docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
            .mapInArrow(compare, "doc_id long, lang_pred string, score double"))
