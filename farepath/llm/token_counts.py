"""Token counts under a unigram vocabulary, without building the tokens.

The tokenizer counted for is the tokenizers library's ``Unigram`` over the
pieces and scores of a sentencepiece model file, with byte fallback, behind
its ``Metaspace`` split: every space becomes U+2581, one is put in front,
and each word starts at one. For a word, an Aho-Corasick automaton over all
pieces lists the matches that end at each place, longest first; a Viterbi
pass over the places carries the best score, and with it the number of
pieces. The library's tie rules hold: among paths of one score, the one
whose last piece starts first stays; a character that is no piece by itself
can be stepped over at the least score minus 10 and counts one token a
UTF-8 byte.

Edge cases: NULL and empty texts have no tokens and score 0; equal texts
equal counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farepath.llm.common import MEMO_ENTRIES, by_slice, columns_of, record_batch, text_of

#: Fixed values of the unigram model: what an unknown character costs below
#: the least score, and the mark that stands for a space.
UNKNOWN_PENALTY = 10.0
SPACE_MARK = "▁"
#: Longer words are counted each time they come; they don't come often.
MEMO_CHARS = 200


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, in order of their ids."""
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def reference_tokenizer(model_path: str, unknown_id: int = 0):
    """The tokenizers-library object whose tokens are counted."""
    from tokenizers import Tokenizer, models, pre_tokenizers
    tokenizer = Tokenizer(models.Unigram(vocabulary(model_path), unk_id=unknown_id, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement=SPACE_MARK, prepend_scheme="always", split=True)
    return tokenizer


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick
        self._automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._longest = max(len(p) for p, _ in pieces)
        self._single = {p for p, _ in pieces if len(p) == 1}
        self._unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        # A line feed that no piece holds is stepped over alone, so a word
        # can be counted in parts on either side of it.
        self._line_feed = not any("\n" in p for p, _ in pieces)
        self._memo: dict[str, tuple[int, float]] = {}

    def viterbi(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best split of one word."""
        # Only places within the longest piece of the current one are kept.
        size = self._longest + 1
        scores, counts = [0.0] * size, [0] * size
        matches = self._automaton.iter(word)
        match = next(matches, None)
        for end, char in enumerate(word):
            here = end + 1
            best, count = None, 0
            while match is not None and match[0] == end:  # longest, so first start, first
                length, score = match[1]
                at = (here - length) % size
                value = score + scores[at]
                if best is None or value > best:
                    best, count = value, counts[at] + 1
                match = next(matches, None)
            if char not in self._single:
                value = self._unknown + scores[end % size]
                if best is None or value > best:
                    best, count = value, counts[end % size] + len(char.encode())
            scores[here % size], counts[here % size] = best, count
        return counts[len(word) % size], scores[len(word) % size]

    def _parts(self, word: str) -> tuple[int, float]:
        """A word whose first character is the space mark."""
        if self._line_feed and "\n" in word:
            found = [self._known(part) for part in word.split("\n")]
            feeds = len(found) - 1
            return sum(n for n, _ in found) + feeds, sum(s for _, s in found) + feeds * self._unknown
        return self._known(word)

    def _known(self, part: str) -> tuple[int, float]:
        if not part:
            return 0, 0.0
        if len(part) > MEMO_CHARS:
            return self.viterbi(part)
        found = self._memo.get(part)
        if found is None:
            if len(self._memo) >= MEMO_ENTRIES:
                self._memo.clear()
            found = self._memo[part] = self.viterbi(part)
        return found

    def count_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and best score of each text. Arrow splits the texts and
        finds the distinct words, each of which is looked up once."""
        marked = pc.replace_substring(texts, SPACE_MARK, " ")
        marked = pc.if_else(pc.or_(pc.starts_with(marked, " "), pc.equal(marked, "")), marked, pc.binary_join_element_wise(" ", marked, ""))
        lists = pc.split_pattern(marked, " ")
        words = lists.flatten().dictionary_encode()
        found = [self._parts(SPACE_MARK + w) for w in words.dictionary.to_pylist()]
        of = words.indices.to_numpy()
        ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        # What stands before the first space mark of a text is no word.
        first = ends[:-1]
        out = []
        for kind, position in ((np.int64, 0), (np.float64, 1)):
            each = np.array([f[position] for f in found], dtype=kind)[of]
            each[first] = 0
            total = np.add.reduceat(each, first) if len(each) else each
            out.append(total)
        return tuple(out)


_COUNTERS: dict[str, UnigramCounter] = {}


def _counter(path: str) -> UnigramCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(vocabulary(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``score`` (of the best split) per row."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def count(batches):
        counter = _counter(model_path)
        for batch in batches:
            for ids, texts in by_slice(*columns_of(batch, "id", "text")):
                yield record_batch(kind, [ids, *counter.count_all(texts)])

    return (docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
            .mapInArrow(count, "doc_id long, n_tokens long, score double"))
