"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is
derived: every match holds all trigrams of at least one alternative in each
clause. The index keeps, for the trigrams that some query names, the
documents that hold them; intersecting the postings of a rule's query gives
its candidates, and only those are verified with the expression itself. A
rule without mandatory trigrams is verified in every document.

The index is built where the texts are, over a bounded slice of documents at
a time: one pass over the bytes finds every named trigram, its postings are
sets of the slice's rows, and the candidates are verified there and then. No
text is shuffled. An index that was built before (:func:`trigram_postings`)
can be handed in; its candidates then meet the texts by id.

Spans are those of the whole match, in code points, end exclusive, leftmost
and non-overlapping per kind; a match that fails the rule's length test is
dropped, not searched again. Letters of either case in a rule are ASCII
letters, so trigrams are taken from the text with ASCII letters lowered.

Edge cases: a NULL or empty text has no spans; every row is verified in its
own text, whatever its id. With an index handed in, rows of one document id
share the candidates of the id, and documents with a NULL id are candidates
of every rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as _c
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farepath.llm.common import by_slice, columns_of, record_batch, text_of

#: Sets of alternatives larger than this are cut into clauses.
MOST_STRINGS = 64
#: Bytes of text that are indexed at once.
SLICE_BYTES = 2_000_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0
    either_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))

    def spans(self, text: str, compiled: re.Pattern | None = None) -> list[tuple[int, int]]:
        found = (compiled or self.compiled()).finditer(text)
        return [m.span() for m in found if len(m[self.group]) >= self.at_least]


#: The three base kinds, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further kinds, of well-known key formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES

Clause = frozenset  # of alternatives, each a frozenset of trigrams


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _clause(strings: set[str]) -> Clause | None:
    """One of the strings occurs: an alternative of trigrams for each, or
    nothing if one is too short to have any."""
    if any(len(s) < 3 for s in strings):
        return None
    return frozenset(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def trigram_query(rule: Rule) -> frozenset[Clause]:
    """Clauses of which all must hold; empty if the rule has no mandatory
    trigrams."""
    clauses: set[Clause] = set()

    def sequence(items, strings: set[str]) -> set[str]:
        """Strings that stand directly before what follows, each of them in
        full since the last cut; a cut turns them into a clause."""
        for op, arg in items:
            here = exact(op, arg)
            if here is None:
                inner(op, arg)
                cut(strings)
                strings = {""}
                continue
            joined = {a + b for a in strings for b in here}
            if len(joined) > MOST_STRINGS:
                cut(strings)
                joined = here
            strings = joined
        return strings

    def cut(strings: set[str]) -> None:
        if (clause := _clause(strings)):
            clauses.add(clause)

    def exact(op, arg) -> set[str] | None:
        """All strings that the item matches, if they are few."""
        if op is _c.LITERAL:
            return {_lower(chr(arg))}
        if op is _c.IN and all(o is _c.LITERAL for o, _ in arg) and len(arg) <= 8:
            return {_lower(chr(a)) for _, a in arg}
        if op is _c.SUBPATTERN:
            return all_exact(arg[3])
        if op is _c.BRANCH:
            each = [all_exact(b) for b in arg[1]]
            out = None if any(e is None for e in each) else set().union(*each)
            return out if out is not None and len(out) <= MOST_STRINGS else None
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] is not _c.MAXREPEAT and arg[1] <= 2:
            once = all_exact(arg[2])
            if once is None:
                return None
            out, power = ({""} if arg[0] == 0 else set()), {""}
            for n in range(1, arg[1] + 1):
                power = {a + b for a in power for b in once}
                if n >= arg[0]:
                    out |= power
            return out if len(out) <= MOST_STRINGS else None
        return None

    def all_exact(items) -> set[str] | None:
        strings = {""}
        for op, arg in items:
            here = exact(op, arg)
            if here is None or len(strings) * len(here) > MOST_STRINGS:
                return None
            strings = {a + b for a in strings for b in here}
        return strings

    def inner(op, arg) -> None:
        """Clauses from inside an item that must occur at least once."""
        if op is _c.SUBPATTERN:
            cut(sequence(arg[3], {""}))
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] > 0:
            cut(sequence(arg[2], {""}))

    cut(sequence(_parser.parse(rule.pattern), {""}))
    return frozenset(clauses)


def query_trigrams(rules) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r) for option in clause for t in option})


def trigram_postings(docs: DataFrame, trigrams: list[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index: ``trigram``, ``doc_id``, one row for each trigram of the
    list that a document holds."""
    lowered = F.translate(text_of(text_column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("lowered"), F.lit(t)), F.lit(t)) for t in trigrams])) if trigrams else F.array().cast("array<string>")
    return (docs.select(F.col(id_column).alias("doc_id"), lowered.alias("lowered"))
            .select("doc_id", F.explode(held).alias("trigram")))


def candidates(postings: DataFrame, rules) -> DataFrame:
    """``doc_id`` and ``rules`` (numbers of the rules whose query the
    document's trigrams meet): the intersection of the rules' postings."""
    found = postings.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))  # at most the listed trigrams
    tests = []
    for number, rule in enumerate(rules):
        query = trigram_query(rule)
        if query:
            met = F.lit(True)
            for clause in query:
                one = F.lit(False)
                for option in clause:
                    one = one | (F.size(F.array_except(F.array(*[F.lit(t) for t in sorted(option)]), F.col("held"))) == 0)
                met = met & one
            tests.append(F.when(met, F.lit(number)))
    if not tests:
        return found.select("doc_id", F.array().cast("array<int>").alias("rules")).limit(0)
    return found.select("doc_id", F.array_compact(F.array(*tests)).alias("rules")).filter(F.size("rules") > 0)


class SliceIndex:
    """Postings of the named trigrams over slices of documents."""

    def __init__(self, trigrams: list[str]):
        self._ascii = [t for t in trigrams if t.isascii()]
        self._others = [t for t in trigrams if not t.isascii()]
        # For three bytes, the number of their trigram; 0 is none.
        self._number = np.zeros(1 << 24, dtype=np.uint8 if len(self._ascii) < 256 else np.uint16)
        for n, trigram in enumerate(self._ascii, start=1):
            a, b, c = trigram.encode()
            self._number[a << 16 | b << 8 | c] = n
        self._lower = np.arange(256, dtype=np.int32)
        self._lower[ord("A"):ord("Z") + 1] += 32

    def postings(self, texts: pa.StringArray) -> dict[str, np.ndarray]:
        """For each trigram, whether each row holds it."""
        lengths = pc.binary_length(texts).to_numpy()
        ends = np.cumsum(lengths, dtype=np.int64)
        out = {t: np.zeros(len(texts), dtype=bool) for t in (*self._ascii, *self._others)}
        whole = b"".join(texts.cast(pa.binary()).to_pylist())
        if len(whole) >= 3:
            x = self._lower[np.frombuffer(whole, dtype=np.uint8)]
            found = self._number[x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
            at = np.flatnonzero(found)
            row = np.searchsorted(ends, at, "right")
            inside = at + 3 <= ends[row]
            for n, trigram in enumerate(self._ascii, start=1):
                out[trigram][row[inside & (found[at] == n)]] = True
        if self._others:
            lowered = [_lower(t) for t in texts.to_pylist()]
            for trigram in self._others:
                out[trigram] = np.array([trigram in t for t in lowered], dtype=bool)
        return out

    @staticmethod
    def candidates(postings: dict[str, np.ndarray], query: frozenset[Clause], rows: int) -> np.ndarray:
        """Rows that meet a query: in every clause all trigrams of one option."""
        met = np.ones(rows, dtype=bool)
        for clause in query:
            one = np.zeros(rows, dtype=bool)
            for option in clause:
                one |= np.logical_and.reduce([postings[t] for t in option])
            met &= one
        return met


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_KIND = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])
_SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def scan_secrets(docs: DataFrame, rules=RULES, id_column: str = "doc_id", text_column: str = "text",
                 postings: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans``, an array of
    (kind, start, end) in order of start, then of the rules. ``postings`` may
    hold an index built before; else it is built here, slice by slice."""
    rules = tuple(rules)
    if postings is not None:
        return _scan_by(postings, docs, rules, id_column, text_column)
    queries = [trigram_query(r) for r in rules]
    named = query_trigrams(rules)

    def scan(batches):
        compiled, index = [r.compiled() for r in rules], SliceIndex(named)
        for batch in batches:
            for ids, texts in by_slice(*columns_of(batch, "id", "text"), SLICE_BYTES):
                held = index.postings(texts)
                out: list[list] = [[] for _ in range(len(texts))]
                for number, (rule, query) in enumerate(zip(rules, queries)):
                    for row in np.flatnonzero(index.candidates(held, query, len(texts))).tolist():
                        out[row] += [(a, number, b) for a, b in rule.spans(texts[row].as_py(), compiled[number])]
                yield record_batch(_KIND, [ids, [[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in sorted(spans)] for spans in out]])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    return rows.mapInArrow(scan, _SCHEMA)


def _scan_by(postings: DataFrame, docs: DataFrame, rules, id_column: str, text_column: str) -> DataFrame:
    """With an index built before: its candidates are joined by id."""
    always = [i for i, r in enumerate(rules) if not trigram_query(r)]
    everything = list(range(len(rules)))

    def verify(batches):
        compiled = [r.compiled() for r in rules]
        for batch in batches:
            ids, texts, chosen = columns_of(batch, "id", "text", "chosen")
            out = []
            for key, text, numbers in zip(ids.to_pylist(), texts.to_pylist(), chosen.to_pylist()):
                todo = everything if key is None else sorted({*always, *(numbers or ())})
                spans = [(a, i, b) for i in todo for a, b in rules[i].spans(text, compiled[i])]
                out.append([{"kind": rules[i].kind, "start": a, "end": b} for a, i, b in sorted(spans)])
            yield record_batch(_KIND, [ids, out])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    met = candidates(postings, rules).select(F.col("doc_id").cast("long").alias("met_id"), F.col("rules").alias("chosen"))
    # The candidates are hashed per partition; the texts need no sort.
    return (rows.join(met.hint("shuffle_hash"), rows["id"] == met["met_id"], "left").select("id", "text", "chosen")
            .mapInArrow(verify, _SCHEMA))


def joined(spans, kinds=None):
    """``kind:start:end`` of the spans, comma-joined."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
