"""Conversations as training text, with the parts that a model is to learn.

A template (:mod:`farepath.llm.chat_template`) is compiled once per task and
renders each conversation's turns in order. What it marks as generation
becomes the loss mask: spans of code points in the formatted text.

*Framing.* Turns begin with ``### `` and the role and end with ``</turn>`` and
a line feed. Texts may hold these control strings themselves, so they are
escaped: a backslash is doubled, and one is put after the first character of
every control string. No control string is left in an escaped text, and
undoing it gives the text back. Roles other than the three known ones stand
behind an ``@``, escaped as well.

*Order and size.* Turns are dealt out by ranges of (conversation, turn) where
the template renders each turn from itself alone, so that a long conversation
is spread over several tasks; otherwise by conversation. They are sorted in
their task and rendered as a stream. The formatted text is written in rows of
whole turns of about ``PART_CHARS`` characters; ``part`` gives their order, and
``whole`` says that a row surely holds its entire conversation.

*Reading back.* The digests come from the written rows: entire conversations
where they lie, the others after a shuffle, row by row in order.

Edge cases: a NULL text or role is empty; a NULL conversation is one of its
own, a NULL turn comes first; equal turns follow in order of role and text,
repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farepath.llm.chat_template import Template
from farepath.llm.common import columns_of, record_batch, small_batches
from farepath.session import new_scratch_path

OPEN, CLOSE, NAMED = "### ", "</turn>", ": "
#: Characters after which a row of formatted text ends with its turn.
PART_CHARS = 1_000_000
#: Characters of formatted text that a task passes on at once.
OUT_CHARS = 4_000_000

TEMPLATE = """
{%- for message in messages -%}
  {%- if message.role == 'assistant' -%}
    {{ open ~ 'Assistant' ~ named }}{% generation %}{{ message.text | escape }}{% endgeneration %}{{ close ~ '\\n' }}
  {%- elif message.role in ['user', 'system'] -%}
    {{ open ~ (message.role | capitalize) ~ named ~ (message.text | escape) ~ close ~ '\\n' }}
  {%- else -%}
    {{ open ~ '@' ~ (message.role | escape(named)) ~ named ~ (message.text | escape) ~ close ~ '\\n' }}
  {%- endif -%}
{%- endfor -%}
"""
ROLES = {"Assistant": "assistant", "User": "user", "System": "system"}


def escape(text: str, *more: str) -> str:
    """``text`` without control strings; ``more`` are further ones. They hold
    no backslash and at least two characters."""
    out = text.replace("\\", "\\\\")
    control = [c for c in (OPEN, CLOSE, *more) if c in out]
    if control:
        out = re.sub(f"(?=({'|'.join(map(re.escape, control))}))(.)", lambda m: m[2] + "\\", out, flags=re.S)
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def compiled(template: str = TEMPLATE) -> Template:
    return Template(template, constants={"open": OPEN, "close": CLOSE, "named": NAMED}, filters={"escape": escape})


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn in a formatted text of :data:`TEMPLATE`."""
    at = 0
    while at < len(text):
        end = text.index(CLOSE + "\n", at)
        name, said = text[at + len(OPEN):end].split(NAMED, 1)
        yield (unescape(name[1:]) if name.startswith("@") else ROLES[name]), unescape(said)
        at = end + len(CLOSE) + 1


_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("text", pa.string()), ("spans", pa.list_(pa.int64()))])


def _rendered(template: Template, turns: Iterable[dict], part_chars: int) -> Iterator[tuple[str, list[int]]]:
    """Rows of formatted text, with the spans to learn as starts and ends."""
    pieces, spans, size = [], [], 0
    for piece in template.render(turns):
        if piece is None:
            if size >= part_chars:
                yield "".join(pieces), spans
                pieces, spans, size = [], [], 0
            continue
        text, learn = piece
        if learn and text:
            if spans and spans[-1] == size:
                spans[-1] = size + len(text)
            else:
                spans += [size, size + len(text)]
        pieces.append(text)
        size += len(text)
    yield "".join(pieces), spans


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Each conversation of a sorted stream with its turns, read on demand."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in columns_of(batch, "conv", "role", "text")))

    stream = rows()
    ahead = next(stream, None)

    def turns(conv: int | None) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead[0] == conv:
            row, ahead = ahead, next(stream, None)
            yield {"role": row[1], "text": row[2]}

    while ahead is not None:
        conv = ahead[0]
        of = turns(conv)
        yield conv, of
        for _ in of:  # what the template didn't read
            pass


def format_conversations(turns: DataFrame, path: str, template: str = TEMPLATE, conv_column: str = "conv_id", turn_column: str = "turn",
                         role_column: str = "role", text_column: str = "text", part_chars: int = PART_CHARS) -> None:
    """Write the formatted conversations under ``path`` as Parquet: ``conv_id``,
    ``part``, ``whole``, ``text``, ``spans`` (start, end, start, end ... in
    code points of the row's text: what a model is to learn)."""
    spread = compiled(template).local

    def render(batches) -> Iterator[pa.RecordBatch]:
        made, compiled_once = TaskContext.get().partitionId() << 32, compiled(template)
        # The last conversation and its rows wait: it may go on in the next task.
        out, size, first = [], 0, True
        last: list | None = None
        for conv, of in _conversations(batches):
            if last is not None:
                last[0][2] = last[1]
            entire, row = not (first and spread), None
            for n, (text, spans) in enumerate(_rendered(compiled_once, of, part_chars)):
                row = [conv, made, False, text, spans]
                made += 1
                out.append(row)
                size += len(text)
                entire = entire and n == 0
                if size >= OUT_CHARS and n:
                    yield record_batch(_PARTS, list(zip(*out)))
                    out, size = [], 0
            last, first = [row, entire], False
            if size >= OUT_CHARS and len(out) > 1:
                yield record_batch(_PARTS, list(zip(*out[:-1])))
                out, size = out[-1:], len(out[-1][3])
        if last is not None:
            last[0][2] = last[1] and not spread
        if out:
            yield record_batch(_PARTS, list(zip(*out)))

    rows = turns.select(F.col(conv_column).cast("long").alias("conv"), F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("conv", "turn") if spread else rows.repartition("conv")
    parts = dealt.sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(render, "conv_id long, part long, whole boolean, text string, spans array<long>")
    with small_batches(turns.sparkSession):
        parts.write.option("compression", "zstd").parquet(path)


def read_formatted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("conv_id long, part long, whole boolean, text string, spans array<long>").parquet(path)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                      ("formatted_chars", pa.int64())])


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of rows of a conversation, read one after the other."""
    conv, state = None, None
    for batch in batches:
        done = []
        for of, text, spans in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "text", "spans"))):
            if state is None or of != conv:
                if state is not None:
                    done.append(_closed(conv, state))
                conv, state = of, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in read_turns(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for lo, hi in zip(spans[::2], spans[1::2]):
                learnt = unescape(text[lo:hi])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
            state[4] += len(text)
        if done:
            yield record_batch(_DIGESTS, list(zip(*done)))
    if state is not None:
        yield record_batch(_DIGESTS, list(zip(_closed(conv, state))))


def _closed(conv: int | None, state: list) -> tuple:
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the written rows: ``conv_id``, ``n_turns``,
    ``turns_sha256`` (of role and text of each turn, a line feed after each),
    ``loss_chars`` and ``loss_sha256`` (of the text under the mask, unescaped),
    ``formatted_chars``."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    entire = formatted.filter("whole").select("conv_id", "text", "spans").mapInArrow(_digest, schema)
    cut = formatted.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "text", "spans")
    return entire.unionByName(cut.mapInArrow(_digest, schema))


def formatted(turns: DataFrame, template: str = TEMPLATE, **options) -> DataFrame:
    """The formatted conversations, written to the scratch folder and read back."""
    path = new_scratch_path(turns.sparkSession, "conversations")
    format_conversations(turns, path, template, **options)
    return read_formatted(turns.sparkSession, path)
