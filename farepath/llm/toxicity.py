"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of word characters, lower case. The field has two labels,
clean and toxic; a token's features are itself, its beginnings and ending,
and the transitions tie neighbours together. Forward-backward gives each
token's marginal; a document's score is its largest one, and its offending
spans are the runs of tokens whose marginal reaches a half, in code points of
the text.

The labels are of documents. Tokens are labelled from them first: features
seen in toxic training documents and (almost) no clean one, as few as explain
the toxic documents, mark their tokens toxic there; all other tokens are clean. The field is then
fitted to these tokens by gradient ascent on the regularised likelihood. All
this is on a bounded sample of labelled documents (:data:`TRAINING_ROWS` and
:data:`TRAINING_BYTES`, up to a quarter of them toxic, those of the smallest id
hashes).

For two labels, forward and backward messages are each one ratio, so a batch
of documents is one pass over time with one vector operation a step.

Edge cases: a NULL text counts as empty; texts without tokens score 0;
without toxic training documents every score is near 0; rows whose label is
NULL are not learned from. Of rows that share an id, the one of the least text
is learned from.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farepath.llm.common import MEMO_ENTRIES, bounded_sample, columns_of, record_batch, slices, text_of, written

TRAINING_ROWS = 4000
#: Bytes of text of the training documents: texts of more than a 64th of them
#: aren't learned from, and of the others those of the smallest id hashes are,
#: of each label, until the next one would go beyond its share.
TRAINING_BYTES = 64_000_000
TOXIC_SHARE = 0.25
#: A feature marks tokens if it is in this many toxic training documents at
#: least, and this much commoner there than in clean ones.
LEAST_DOCUMENTS = 4
LEAST_RATIO = 10.0
#: Least likelihood-ratio statistic of such a feature, far above what chance
#: gives one of some hundred thousand features.
LEAST_EVIDENCE = 25.0
#: Share of the toxic training documents that makes such a feature marking
#: whatever else explains them.
COMMON_SHARE = 0.05
#: Words of a document that are compared to find copies.
SKETCH = 16
ITERATIONS = 40
L2 = 0.02

BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Tokens after which a training sequence is cut, so that a pass over time is
#: short however long a document is.
CUT = 400

TOKEN = re.compile(r"\w+")


def token_features(token: str) -> list[str]:
    out = ["w:" + token]
    for n in BEGINNINGS:
        if len(token) >= n:
            out.append(f"b{n}:{token[:n]}")
    if len(token) > 4:
        out.append("e:" + token[-3:])
    return out


@dataclass
class Coded:
    """Documents as numbers: ``words`` by first appearance, the word of every
    token, the tokens of each document, and the features of each word."""
    words: list[str]
    flat: np.ndarray
    lengths: np.ndarray
    names: list[str]
    features: np.ndarray
    counts: np.ndarray

    def documents(self) -> list[np.ndarray]:
        return np.split(self.flat, np.cumsum(self.lengths)[:-1]) if len(self.lengths) else []

    def features_of(self, words: np.ndarray) -> np.ndarray:
        """The features of the words, one after the other."""
        n = self.counts[words]
        first = (np.cumsum(self.counts) - self.counts)[words]
        return self.features[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)]


def coded(documents: Iterable[list[str]]) -> Coded:
    number: dict[str, int] = {}
    parts = [np.fromiter((number.setdefault(w, len(number)) for w in tokens), dtype=np.int32, count=len(tokens)) for tokens in documents]
    names: dict[str, int] = {}
    features, counts = [], []
    for word in number:
        found = [names.setdefault(f, len(names)) for f in token_features(word)]
        features += found
        counts.append(len(found))
    return Coded(list(number), np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array([len(x) for x in parts], dtype=np.int64),
                 list(names), np.array(features, dtype=np.int32), np.array(counts, dtype=np.int64))


def _time_major(lengths: np.ndarray):
    """Places of the tokens of all sequences when sorted by time: sequences
    longest first, so those alive at a step stand in front."""
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), dtype=np.int64)
    rank[order] = np.arange(len(lengths))
    longest = int(lengths.max(initial=0))
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    starts = np.append(0, np.cumsum(alive))
    step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return starts[step] + np.repeat(rank, lengths), starts, alive


@dataclass
class ChainField:
    """Weights relative to the label clean: features that speak for toxic, a
    bias, and the transitions clean-toxic, toxic-clean, toxic-toxic."""
    weights: dict[str, float]
    bias: float
    transitions: tuple[float, float, float]

    def emission(self, token: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in token_features(token))

    def marginals(self, u: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(toxic) of each token from emissions ``u`` of sequences that
        stand one after the other."""
        return _messages(u, lengths, self.transitions)[0]


def _messages(u: np.ndarray, lengths: np.ndarray, transitions, pairs: bool = False):
    if not len(u):
        return np.zeros(0), 0.0, np.zeros(3)
    place, starts, alive = _time_major(lengths)
    e = np.empty(len(u))
    e[place] = np.exp(np.clip(u, -30, 30))
    ct, tc, tt = np.exp(np.clip(transitions, -20, 20))
    r, s = np.empty(len(u)), np.ones(len(u))
    steps = len(alive)
    r[:alive[0]] = e[:alive[0]]
    for t in range(1, steps):
        a, n, p = starts[t], alive[t], starts[t - 1]
        before = r[p:p + n]
        r[a:a + n] = e[a:a + n] * (ct + before * tt) / (1 + before * tc)
    for t in range(steps - 2, -1, -1):
        a, n, q = starts[t], alive[t + 1], starts[t + 1]
        after = e[q:q + n] * s[q:q + n]
        s[a:a + n] = (tc + tt * after) / (1 + ct * after)
    if not pairs:
        p = r * s
        return (p / (1 + p))[place], 0.0, np.zeros(3)
    log_z, expected = 0.0, np.zeros(3)
    for t in range(steps):
        a, n = starts[t], alive[t]
        m = alive[t + 1] if t + 1 < steps else 0
        now = r[a:a + n]
        log_z += np.log1p(now[:m] * tc).sum() + np.log1p(now[m:]).sum()
        if m:
            after = e[starts[t + 1]:starts[t + 1] + m] * s[starts[t + 1]:starts[t + 1] + m]
            parts = np.stack([ct * after, now[:m] * tc, now[:m] * tt * after])
            expected += (parts / (1 + parts.sum(axis=0))).sum(axis=1)
    p = r * s
    return (p / (1 + p))[place], log_z, expected


def _without_copies(tokens: Coded) -> list[int]:
    """Documents that don't share half of a small sketch of their words with
    an earlier one: copies would count their rare words again and again."""
    hashes = np.array([zlib.crc32(w.encode()) for w in tokens.words], dtype=np.int64)
    seen: dict[int, set[int]] = {}
    kept = []
    for i, words in enumerate(tokens.documents()):
        sketch = np.unique(hashes[words])[:SKETCH].tolist()
        shared: dict[int, int] = {}
        for h in sketch:
            for other in seen.get(h, ()):
                shared[other] = shared.get(other, 0) + 1
        if max(shared.values(), default=0) * 2 < max(1, len(sketch)):
            kept.append(i)
            for h in sketch:
                seen.setdefault(h, set()).add(i)
    return kept


def _evidence(a: int, n_a: int, b: int, n_b: int) -> float:
    """Likelihood ratio of two shares against one common share."""
    share = (a + b) / (n_a + n_b)
    each = ((a, n_a * share), (n_a - a, n_a * (1 - share)), (b, n_b * share), (n_b - b, n_b * (1 - share)))
    return 2 * sum(x * math.log(x / e) for x, e in each if x > 0)


def marking_features(tokens: Coded, toxic: list[int], least: int = LEAST_DOCUMENTS, ratio: float = LEAST_RATIO) -> set[str]:
    """Features that tell toxic documents: those far commoner there than in
    clean ones, taken greedily, the one that explains most documents not yet
    explained first, until none explains ``least``."""
    kept = _without_copies(tokens)
    counts = np.zeros((2, len(tokens.names)), dtype=np.int64)
    documents = tokens.documents()
    of_toxic: dict[int, np.ndarray] = {}
    for i in kept:
        found = np.unique(tokens.features_of(np.unique(documents[i])))
        counts[toxic[i], found] += 1
        if toxic[i]:
            of_toxic[i] = found
    n = [max(1, sum(toxic[i] == k for i in kept)) for k in (0, 1)]
    far = (counts[1] >= least) & (counts[1] / n[1] >= ratio * (counts[0] + 0.1) / n[0])
    able = {tokens.names[f]: int(f) for f in np.flatnonzero(far)
            if _evidence(int(counts[1, f]), n[1], int(counts[0, f]), n[0]) >= LEAST_EVIDENCE}
    told = np.zeros(len(tokens.names), dtype=bool)
    told[list(able.values())] = True
    holders: dict[str, set[int]] = {f: set() for f in able}
    for i, found in of_toxic.items():
        for f in found[told[found]].tolist():
            holders[tokens.names[f]].add(i)
    marking: set[str] = set()
    while holders:
        # The longest beginning of those that explain the same documents.
        best = max(holders, key=lambda f: (len(holders[f]), f.startswith("b"), len(f), f))
        explained = set(holders.pop(best))
        if len(explained) < least:
            break
        marking.add(best)
        for f in list(holders):
            holders[f] -= explained
            if len(holders[f]) < least:
                del holders[f]
    # What stands in a good part of all toxic documents marks on its own.
    return marking | {f for f, i in able.items() if counts[1, i] >= max(least, COMMON_SHARE * n[1])}


def label_tokens(tokens: Coded, toxic: list[int]) -> np.ndarray:
    """Whether each token is toxic, from document labels."""
    marking = marking_features(tokens, toxic)
    marks = np.fromiter((f in marking for f in tokens.names), dtype=bool, count=len(tokens.names))
    marked = np.zeros(len(tokens.words), dtype=bool)
    marked[np.repeat(np.arange(len(tokens.words)), tokens.counts)[marks[tokens.features]]] = True
    return marked[tokens.flat] & np.repeat(np.array(toxic, dtype=bool), tokens.lengths)


class Likelihood:
    """The regularised log-likelihood of token labels ``y``. Parameters are
    the weights of the features in ``names``, the bias and the transitions.
    Features that no toxic token has start, and without evidence stay, at 0;
    they are left out."""

    def __init__(self, tokens: Coded, y: np.ndarray, l2: float = L2):
        found = np.unique(tokens.features_of(np.unique(tokens.flat[y])))
        self.names = sorted(tokens.names[f] for f in found.tolist())
        place = {f: i for i, f in enumerate(self.names)}
        number = np.full(len(tokens.names), -1)
        number[found] = [place[tokens.names[f]] for f in found.tolist()]
        known = number[tokens.features] >= 0
        self.rows = np.repeat(np.arange(len(tokens.words)), tokens.counts)[known]
        self.columns = number[tokens.features[known]]
        self.n_words, self.flat, self.y = len(tokens.words), tokens.flat, y.astype(np.float64)
        self.lengths = np.array([min(CUT, n - i) for n in tokens.lengths.tolist() for i in range(0, max(1, n), CUT)], dtype=np.int64)
        first = np.zeros(len(y), dtype=bool)
        first[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = True
        before, after = np.roll(self.y, 1)[~first], self.y[~first]
        self.observed = np.array([((1 - before) * after).sum(), (before * (1 - after)).sum(), (before * after).sum()])
        self.penalty = l2 * np.append(np.ones(len(self.names)), np.full(4, 0.01))

    def at(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and gradient."""
        n = len(self.names)
        u = (np.bincount(self.rows, theta[self.columns], self.n_words) + theta[n])[self.flat]
        p, log_z, expected = _messages(u, self.lengths, theta[-3:], pairs=True)
        left = np.bincount(self.flat, self.y - p, self.n_words)
        gradient = np.concatenate([np.bincount(self.columns, left[self.rows], n), [left.sum()], self.observed - expected])
        value = (self.y * u).sum() + self.observed @ theta[-3:] - log_z - (self.penalty * theta ** 2).sum() / 2
        return value, gradient - self.penalty * theta


def fit(tokens: Coded, y: np.ndarray, iterations: int = ITERATIONS, l2: float = L2) -> ChainField:
    """Maximise the likelihood of the token labels ``y``."""
    likelihood = Likelihood(tokens, y, l2)
    n = len(likelihood.names)
    theta = np.zeros(n + 4)
    theta[n] = np.log((y.sum() + 0.5) / (len(y) + 1)) if len(y) else -10.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, iterations + 1 if len(y) else 1):
        _, gradient = likelihood.at(theta)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient ** 2
        theta += 0.25 * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.99 ** t)) + 1e-6)
    weights = {f: float(v) for f, v in zip(likelihood.names, theta) if abs(v) > 1e-6}
    return ChainField(weights, float(theta[n]), tuple(float(v) for v in theta[-3:]))


# --- Spark --------------------------------------------------------------------

def learn(docs: DataFrame, labels: DataFrame, training: Column, label_column: str = "toxic", id_column: str = "doc_id",
          text_column: str = "text", training_rows: int = TRAINING_ROWS, training_bytes: int = TRAINING_BYTES) -> ChainField:
    rows = labels.filter(training & F.col(label_column).isNotNull()).select(F.col(id_column).alias("label_id"), (F.col(label_column) > 0).cast("int").alias("label"))
    n_toxic = int(training_rows * TOXIC_SHARE)
    samples = [bounded_sample(rows.filter(F.col("label") == k), "label_id", n) for k, n in ((1, n_toxic), (0, training_rows - n_toxic))]
    # At most training_rows pairs of an id and a label: a proven bound.
    sample = F.broadcast(samples[0].union(samples[1]).distinct())
    texts = docs.select(F.col(id_column).alias("text_id"), text_of(text_column).alias("the_text"))
    # One text for each pair, so training_rows texts at most.
    found = written(texts.join(sample, F.col("text_id") == F.col("label_id")).groupBy("label_id", "label").agg(F.min("the_text").alias("the_text")), "toxic-training")
    sizes = found.select("label_id", "label", F.octet_length("the_text").cast("long").alias("bytes")).filter(F.col("bytes") <= training_bytes // 64)
    so_far = F.sum("bytes").over(Window.partitionBy("label").orderBy(F.xxhash64("label_id"), "label_id"))
    share = F.when(F.col("label") == 1, TOXIC_SHARE).otherwise(1 - TOXIC_SHARE) * training_bytes
    fits = sizes.withColumn("so_far", so_far).filter(F.col("so_far") <= share).select("label_id", "label")
    kept = found.join(F.broadcast(fits), ["label_id", "label"]).select("label_id", "label", "the_text").collect()
    kept.sort(key=lambda r: (r["label_id"], r["label"]))
    tokens = coded([w.lower() for w in TOKEN.findall(r["the_text"])] for r in kept)
    return fit(tokens, label_tokens(tokens, [r["label"] for r in kept]))


class _Emissions(dict):
    """Emission of each token as it stands in a text (its letters lowered for
    the model), computed when first asked for."""

    def __init__(self, model: ChainField):
        self._model = model

    def __missing__(self, token: str) -> float:
        value = self[token] = self._model.emission(token.lower())
        return value


def score(docs: DataFrame, model: ChainField, id_column: str = "doc_id", text_column: str = "text", at_least: float = 0.5) -> DataFrame:
    """``doc_id``, ``score`` and ``spans`` (start, end, marginal) per row."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])
    kind = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def spans_of(text: str, p: np.ndarray) -> list[dict]:
        out: list[dict] = []
        last = -2
        places = [m.span() for m in TOKEN.finditer(text)]
        for i in np.flatnonzero(p >= at_least).tolist():
            start, end = places[i]
            if i == last + 1:
                out[-1] = {"start": out[-1]["start"], "end": end, "marginal": max(out[-1]["marginal"], float(p[i]))}
            else:
                out.append({"start": start, "end": end, "marginal": float(p[i])})
            last = i
        return out

    def run(batches):
        known = _Emissions(model)
        for batch in batches:
            ids, texts = columns_of(batch, "id", "text")
            texts = texts.to_pylist()
            for lo, hi in slices(texts):
                if len(known) > MEMO_ENTRIES:
                    known = _Emissions(model)
                get = known.__getitem__
                found = [list(map(get, TOKEN.findall(t))) for t in texts[lo:hi]]
                lengths = np.array([len(f) for f in found], dtype=np.int64)
                u = np.fromiter((x for f in found for x in f), dtype=np.float64, count=int(lengths.sum()))
                p = model.marginals(u, lengths)
                ends = np.cumsum(lengths)
                scores, spans = [], []
                for text, a, b in zip(texts[lo:hi], (ends - lengths).tolist(), ends.tolist()):
                    most = float(p[a:b].max()) if b > a else 0.0
                    scores.append(most)
                    spans.append(spans_of(text, p[a:b]) if most >= at_least else [])
                yield record_batch(kind, [ids.slice(lo, hi - lo), scores, spans])

    return (docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
            .mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,end:long,marginal:double>>"))
