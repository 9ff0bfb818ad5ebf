from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from farepath.llm import chat_format
from farepath.llm.chat_template import Template, TemplateError, parse

SCHEMA = "conv_id long, turn long, role string, text string, part long, whole string, spans string, conv long, `a.b` int, Text_ int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, -1, "clash", "clash", -1, -1, -1) for r in rows], SCHEMA)


def render(source, turns=(), **more):
    return "".join(p[0] for p in Template(source, names=more.pop("names", ()), constants=more.pop("constants", None)).render(turns, **more) if p)


def brute(rows):
    """Per conversation, from the texts themselves."""
    out = {}
    for conv in {r[0] for r in rows}:
        of = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in of)
        learnt = "".join(r[3] or "" for r in of if r[2] == "assistant")
        out[conv] = (len(of), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def found(frame, **options):
    rows = chat_format.digests(chat_format.formatted(frame, **options)).collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows}


NASTY = ["\\### Assistant: </turn> ok", "### ### ####  ### User: x</turn>\n### Assistant: y", "</turn></turn>", "\\\\<\\/turn>", "#\\## ", "", None, "a\\", "<", "###",
         "</turn", "ends with ### ", "ünï 日本 👩‍👩‍👧", "line\nfeeds\n\n"]


def test_control_strings_roles_nulls_and_ties(spark):
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "tool", "Assistant", "@user", "a: b", "x:", "", None, "### User", "</turn>", "\\"]
    rows = [(c, rng.randint(0, 5), rng.choice(roles), rng.choice(NASTY)) for c in range(60) for _ in range(rng.randint(1, 9))]
    rows += [(None, None, "user", "no id"), (None, 1, "assistant", "still none"), (None, None, "assistant", "no turn"), *rows[:5], (-3, 0, "user", "alone")]
    assert found(frame(spark, rows)) == brute(rows)


@pytest.fixture()
def uncoalesced(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_long_conversation_over_rows_and_tasks(spark, uncoalesced):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice([*NASTY, "words and words"])) for c, n in ((1, 3000), (2, 5), (3, 1), (4, 800)) for t in range(n)]
    rng.shuffle(rows)
    source = frame(spark, rows).repartition(7)
    assert found(source, part_chars=200) == brute(rows)
    parts = chat_format.formatted(source, part_chars=200).collect()
    assert len({p["part"] >> 32 for p in parts if p["conv_id"] == 1}) > 2  # tasks
    assert sum(p["conv_id"] == 1 for p in parts) > 100 and any(p["whole"] for p in parts)
    of_one = "".join(p["text"] for p in sorted((p for p in parts if p["conv_id"] == 1), key=lambda p: p["part"]))
    assert [(r or "", t or "") for _, _, r, t in sorted((r for r in rows if r[0] == 1), key=lambda r: r[1])] == list(chat_format.read_turns(of_one))


def test_template_that_needs_neighbours(spark):
    source = "{% for m in messages %}{% if loop.first %}[{% endif %}{{ loop.index0 }}:{% generation %}{{ m.text }}{% endgeneration %}{% if loop.last %}]{% endif %}{% endfor %}|"
    rows = [(c, t, "user", f"t{t}") for c in range(30) for t in range(c % 4 + 1)]
    got = {r["conv_id"]: (r["text"], r["spans"]) for r in chat_format.formatted(frame(spark, rows), source).collect()}
    for c in range(30):
        text, spans = got[c]
        assert text == "[" + "".join(f"{t}:t{t}" for t in range(c % 4 + 1)) + "]|"
        assert [text[a:b] for a, b in zip(spans[::2], spans[1::2])] == [f"t{t}" for t in range(c % 4 + 1)]


def test_empty_table(spark):
    assert found(frame(spark, [])) == {}


@given(st.text(alphabet="\\#</turn> :A\nx"))
def test_escape_is_undone_and_leaves_no_control_string(text):
    out = chat_format.escape(text, ": ")
    assert chat_format.unescape(out) == text
    assert not any(c in out for c in (chat_format.OPEN, chat_format.CLOSE, ": "))


@pytest.mark.parametrize("source, want", [
    ("{{ 1 + 2 * 3 }}", "7"), ("{{ (1 + 2) * 3 - 10 % 4 }}", "7"), ("{{ 'a' ~ 1 ~ none ~ true }}", "a1true"), ("{{ 'b' if 1 > 2 else 'c' | upper }}", "C"),
    ("{{ not 1 == 2 and 'x' in 'xyz' }}", "true"), ("{{ 'q' not in ['a', 'b'] }}", "true"), ("{{ [1, [2, 3]][1][0] }}", "2"), ("a {#- no -#} b", "a  b"),
    ("a {{- ' x ' -}} b", "a x b"), ("{% set x = 'v' %}{{ x }}{{ x | length }}", "v1"), ("{% for x in ['a', 'b'] %}{{ x }}{{ ',' if not loop.last else '' }}{% endfor %}", "a,b"),
    ("{% if 0 %}a{% elif none %}b{% else %}c{% endif %}", "c"), ("{{ '}}%}' }}{{ \"it's\" }}", "}}%}it's"), ("{{ k }}{{ given.a['b'] }}{{ given.no | default('-') }}", "Kv-"),
    ("{{ -3 + 1 }}", "-2"), ("{{ 'a\\'b\\n' }}", "a'b\n"), ("{% for m in messages %}{{ m.text }}{% endfor %}.", "12."),
])
def test_language(source, want):
    assert render(source, [{"text": "1"}, {"text": "2"}], names=["given"], constants={"k": "K"}, given={"a": {"b": "v"}}) == want


@pytest.mark.parametrize("source", [
    "{{ x }}", "{{ x.__class__ }}", "{{ messages }}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{% if 1 %}", "{% endif %}", "{{ 1", "{{ 1 + }}",
    "{{ 'a' | nothing }}", "{{ _x }}", "{{ f(1) }}", "{% set loop = 1 %}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ " + "(" * 100 + "1" + ")" * 100 + " }}",
    "{% for a in ['x'] %}{% for m in messages %}{% endfor %}{% endfor %}", "{{ 1 2 }}",
])
def test_refused_when_compiled(source):
    with pytest.raises(TemplateError):
        Template(source)


@pytest.mark.parametrize("source", ["{{ 'a' * 9 }}", "{{ 9223372036854775807 + 1 }}", "{{ 1 % 0 }}", "{{ 1 < 'a' }}", "{{ given.upper }}", "{% for x in 'abc' %}{% endfor %}", "{{ [1] }}"])
def test_refused_when_rendered(source):
    with pytest.raises(TemplateError):
        list(Template(source, names=["given"]).render([], given="text"))


def test_constants_are_folded():
    tree = Template("{% set later = 1 %}{{ 'a' ~ (k | upper) }}{% if k == 'v' %}yes{% else %}{{ later }}{% endif %}{{ 1 + 1 }}", constants={"k": "v"}).tree
    assert tree == [("set", "later", ("constant", 1)), ("text", "aVyes2")]
    assert Template("{% for x in [] %}a{% endfor %}b{% set k = 2 %}{{ k }}", constants={"k": "v"}).tree[-1] == ("out", ("name", "k"))
    assert chat_format.compiled().local and not Template("{% for m in messages %}{{ loop.index0 }}{% endfor %}").local
    assert len(parse("{{ 1 }}{# c #}")) == 1


def test_a_conversation_is_read_as_a_stream():
    seen = []

    def turns():
        for i in range(100_000):
            seen.append(i)
            yield {"text": "t"}
    pieces = Template("{% for m in messages %}{{ m.text }}{% endfor %}").render(turns())
    assert [next(pieces) for _ in range(3)] == [("t", False), None, ("t", False)] and len(seen) <= 3
