"""Quality classifier: a generalised additive model with pairwise terms.

Each text becomes a short row of numbers (:data:`FEATURES`). Each number is
put into a bin; the model is one lookup table per number and one per chosen
pair of numbers, and a text's score is the logistic function of the sum of
its table entries.

The tables are learned by cyclic boosting: in turn, each number gets a tree
of at most three leaves fitted to the current gradient, whose small step is
added to its table; then the pairs that explain most of what is left get
trees over both numbers in the same way. All fitting is on a bounded sample
of labelled rows (:data:`TRAINING_ROWS`, those of the smallest id hashes);
only their numbers, not their texts, reach the driver.

Edge cases: a NULL text counts as empty, whose numbers are all 0; without
training rows, or with one class only, every score is the share of label 1
(0.5 without rows); rows whose label is NULL are not learned from; several
labels of one document are all learned from.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farepath.llm.common import bounded_sample, columns_of, filtered_rows, let_go, record_batch, text_of

TRAINING_ROWS = 12_000
BINS = 24
ROUNDS = 120
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.15

FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_words", "upper", "lower", "digits", "non_ascii", "blank",
    "line_feeds", "stops", "commas", "quotes", "brackets", "marks", "bars", "exclamations", "marked_words",
    "distinct_lines", "longest_word", "top_word",
)

_CLASS = np.zeros(256, dtype=np.int64)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\v\f", "\n", ".?:;", ",",
                             "\"'`", "()[]{}<>", "#$%&*@^~+=\\/_-", "|", "!"), start=1):
    for _c in _chars:
        _CLASS[ord(_c)] = _i
_CLASS[128:] = 13


def features_of(text: str) -> list[float]:
    """The numbers of one text, over the whole of it."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return [0.0] * len(FEATURES)
    n = np.bincount(_CLASS, weights=np.bincount(raw, minlength=256), minlength=14)
    words = text.split()
    n_words = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeated = sum(map(str.__eq__, words, words[1:])) if len(words) > 1 else 0
    marked = sum(1 for w in counts if not w[-1].isalnum() and w[-1] not in ".,")
    lines = text.split("\n")
    size = float(len(raw))
    letters = max(1.0, n[1] + n[2] + n[13])
    return [
        float(np.log1p(len(words))), (size - n[4] - n[5]) / n_words, len(counts) / n_words, repeated / n_words,
        n[1] / letters, n[2] / letters, n[3] / size, n[13] / size, n[4] / size, n[5] / size, n[6] / n_words, n[7] / n_words,
        n[8] / size, n[9] / size, n[10] / n_words, n[11] / n_words, n[12] / n_words, marked / max(1, len(counts)),
        len(set(lines)) / len(lines), float(np.log1p(max(map(len, counts), default=0))), max(counts.values(), default=0) / n_words,
    ]


def features_frame(docs: DataFrame, keys: list[str], text_column: str = "text") -> DataFrame:
    """The key columns and ``features`` (array of double) per row."""
    rows = docs.select(*keys, text_of(text_column).alias("the_text"))
    names = rows.columns[:-1]

    def measure(batches):
        for batch in batches:
            found = [features_of(t.as_py()) for t in batch.column(len(names))]
            columns = [batch.column(i) for i in range(len(names))] + [pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "features"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", features array<double>"
    return rows.mapInArrow(measure, schema)


# --- the model ----------------------------------------------------------------

@dataclass
class PairwiseAdditiveModel:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: additions of table entries by bin."""
        total = np.full(len(x), self.intercept)
        if len(x):
            b = self.bins(x)
            for i, table in enumerate(self.tables):
                total += table[b[:, i]]
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _best_cut(g: np.ndarray, h: np.ndarray, axis: int = -1):
    """Gain of each cut along an axis of gradient and curvature sums."""
    left_g, left_h = np.cumsum(g, axis=axis), np.cumsum(h, axis=axis)
    all_g, all_h = np.sum(g, axis=axis, keepdims=True), np.sum(h, axis=axis, keepdims=True)
    return left_g ** 2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g ** 2 / (all_h + 1)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step of a tree with up to three leaves over the bins of one number."""
    cuts: list[int] = []
    for _ in range(2):
        best = (1e-9, None)
        bounds = [0, *cuts, len(g)]
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                gain = _best_cut(g[a:b], h[a:b])[:-1]
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], a + at + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    bounds = [0, *cuts, len(g)]
    step = np.zeros(len(g))
    for a, b in zip(bounds, bounds[1:]):
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of a tree over two numbers: one cut of the first, then
    one of the second on either side."""
    best, step = 0.0, np.zeros_like(g)
    low_g, low_h = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
    sides = [(low_g, low_h), (low_g[-1:] - low_g, low_h[-1:] - low_h)]
    gains, cuts = 0.0, []
    for sg, sh in sides:
        gain = _best_cut(sg, sh, axis=1)[:, :-1] if g.shape[1] > 1 else np.zeros((len(g), 1))
        cuts.append(gain.argmax(axis=1))
        whole = sg.sum(axis=1) ** 2 / (sh.sum(axis=1) + 1)
        gains = gains + gain.max(axis=1) + whole
    total = g.sum() ** 2 / (h.sum() + 1)
    at = int(gains[:-1].argmax()) if len(g) > 1 else 0
    best = float(gains[at] - total)
    for (sg, sh), cut, rows in zip(sides, cuts, (slice(0, at + 1), slice(at + 1, None))):
        c = int(cut[at]) + 1
        for columns in (slice(0, c), slice(c, None)):
            step[rows, columns] = sg[at, columns].sum() / (sh[at, columns].sum() + 1)
    return best, step


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS,
        n_pairs: int = PAIRS, rate: float = RATE) -> PairwiseAdditiveModel:
    """Boost the tables on numbers ``x`` and labels ``y`` (0 or 1)."""
    n_features = x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(0) for i in range(n_features)]
    model = PairwiseAdditiveModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges])
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(len(y), model.intercept)

    def gradient():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            g, h = gradient()
            step = rate * _tree(np.bincount(b[:, i], g, len(table)), np.bincount(b[:, i], h, len(table)))
            table += step
            total += step[b[:, i]]

    def sums(i, j, g, h):
        shape = (len(model.tables[i]), len(model.tables[j]))
        at = b[:, i] * shape[1] + b[:, j]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    g, h = gradient()
    ranked = sorted(((-_pair_tree(*sums(i, j, g, h))[0], i, j) for i in range(n_features) for j in range(i + 1, n_features)))
    model.pairs = [(i, j) for _, i, j in ranked[:n_pairs]]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = gradient()
            step = rate * _pair_tree(*sums(i, j, g, h))[1]
            table += step
            total += step[b[:, i], b[:, j]]
    return model


# --- Spark --------------------------------------------------------------------

def learn(docs: DataFrame, labels: DataFrame, training: Column, label_column: str = "quality", id_column: str = "doc_id",
          text_column: str = "text", training_rows: int = TRAINING_ROWS) -> PairwiseAdditiveModel:
    """Fit on at most ``training_rows`` rows of ``labels`` that meet
    ``training`` and have a label."""
    rows = labels.filter(training & F.col(label_column).isNotNull()).select(F.col(id_column).alias("label_id"), F.col(label_column).cast("int").alias("label"))
    sample = bounded_sample(rows, "label_id", training_rows)
    # At most training_rows pairs of an id and a label: a proven bound.
    texts = docs.select(F.col(id_column).alias("text_id"), F.col(text_column).alias("the_text"))
    chosen = texts.join(F.broadcast(sample), F.col("text_id") == F.col("label_id")).select("label_id", "label", "the_text")
    found = features_frame(chosen, ["label_id", "label"], "the_text").collect()
    found.sort(key=lambda r: (r["label_id"], r["label"], r["features"]))
    x = np.array([r["features"] for r in found], dtype=np.float64).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r["label"] for r in found], dtype=np.float64))


def score(docs: DataFrame, model: PairwiseAdditiveModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` per row."""
    kind = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            ids, texts = columns_of(batch, "id", "text")
            x = np.array([features_of(t.as_py()) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))
            yield record_batch(kind, [ids, model.scores(x)])

    return docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: PairwiseAdditiveModel, at_least: float, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``at_least`` that, in one pass
    over the table, without a join."""
    place = docs.columns.index(text_column)

    def keep(batch):
        let_go()
        x = np.array([features_of(t.as_py() or "") for t in batch.column(place)], dtype=np.float64).reshape(batch.num_rows, len(FEATURES))
        return model.scores(x) >= at_least

    return filtered_rows(docs, keep)
