"""A small template language for conversations, compiled to Python closures.

Text with ``{{ expression }}``, ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% for x in list %} {% endfor %}``, ``{% set x = expression %}``,
``{% generation %} {% endgeneration %}`` (what a model is to learn) and
``{# comments #}``; a ``-`` inside a mark strips the white space beside it.
Expressions know strings, whole numbers, ``true``, ``false``, ``none``, lists,
names, ``a.b``, ``a['b']``, ``a if c else b``, ``or and not``, ``== != < <= >
>= in``, ``+ - * %``, ``~`` (joins as text) and filters, ``a | name(b)``.

*Sandbox.* A template reaches the given values only: keys of dictionaries,
places of lists, and the filters given to it. There are no calls, no Python
attributes, no names that begin with an underscore, no repeated strings, and
numbers stay within 64 bits. Loops run over given lists or over the one
stream. A name that nobody sets is an error when the template is compiled.

*Compilation.* The text is parsed into a syntax tree; constants are folded in
it (operators, filters and conditions of constants, dead branches, joined
pieces of text); each node that is left becomes a closure. Rendering yields
pieces as (text, whether a model is to learn it).

*Stream.* One list, such as the turns of a conversation, is an iterator that
is read once, by one loop outside all others: a conversation is rendered with
one turn and its neighbours in memory, however long it is. ``None`` is
yielded between its items, where the output may be cut. ``loop.index0``,
``loop.first`` and ``loop.last`` are known there.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

Piece = tuple[str, bool] | None


class TemplateError(ValueError):
    """A template that can't be compiled, or a value it can't take."""


_STRING = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_MARK = re.compile(rf"\{{\{{-?(?P<out>(?:{_STRING}|[^'\"])*?)-?\}}\}}|\{{%-?(?P<do>(?:{_STRING}|[^'\"])*?)-?%\}}|\{{#.*?#\}}", re.S)
_TOKEN = re.compile(rf"\s*(?:(?P<string>{_STRING})|(?P<number>\d+)|(?P<name>[A-Za-z]\w*)|(?P<sign>==|!=|<=|>=|[-+*%~|.,()\[\]<>=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_DEPTH = 40
_WORDS = {"true": True, "false": False, "none": None}
_RESERVED = {*_WORDS, "and", "or", "not", "in", "if", "else", "for", "set", "elif", "endif", "endfor", "generation", "endgeneration", "loop"}


def _number(value: Any) -> int:
    if type(value) is not int or not -2 ** 63 <= value < 2 ** 63:
        raise TemplateError(f"not a whole number of 64 bits: {value!r:.40}")
    return value


def _add(a: Any, b: Any) -> Any:
    if isinstance(a, str) and isinstance(b, str):
        return a + b
    return _number(_number(a) + _number(b))


def _text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"not a text: {type(value).__name__}")


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict) and isinstance(key, str):
        return of.get(key)
    if isinstance(of, list) and type(key) is int:
        return of[key] if -len(of) <= key < len(of) else None
    raise TemplateError(f"no item {key!r:.40} of a {type(of).__name__}")


def _compared(how: Callable) -> Callable:
    def compare(a: Any, b: Any) -> bool:
        if type(a) is not type(b) or not isinstance(a, (str, int)):
            raise TemplateError("values of different kinds are compared")
        return how(a, b)
    return compare


def _inside(a: Any, b: Any) -> bool:
    if isinstance(b, (list, dict)) or isinstance(b, str) and isinstance(a, str):
        return a in b
    raise TemplateError(f"nothing is in a {type(b).__name__}")


_OPERATORS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": _compared(operator.lt), "<=": _compared(operator.le), ">": _compared(operator.gt), ">=": _compared(operator.ge),
    "in": _inside, "not in": lambda a, b: not _inside(a, b), "+": _add, "-": lambda a, b: _number(_number(a) - _number(b)),
    "*": lambda a, b: _number(_number(a) * _number(b)), "%": lambda a, b: _modulo(a, b), "~": lambda a, b: _text(a) + _text(b), "item": _item,
}
#: Binary operators by how tightly they bind, loosest first.
_LEVELS = [("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "%")]


def _modulo(a: Any, b: Any) -> int:
    if not _number(b):
        raise TemplateError("remainder of a division by 0")
    return _number(a) % b


#: Filters that every template has.
FILTERS: dict[str, Callable] = {
    "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "capitalize": lambda x: _text(x).capitalize(), "trim": lambda x: _text(x).strip(),
    "length": lambda x: len(x) if isinstance(x, (str, list)) else len(_text(x)), "default": lambda x, other: other if x is None else x,
}


class _Expression:
    """Parses one expression into a tree of tuples."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"not understood: {source[at:at + 40]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = self.depth = 0

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in words

    def take(self, *words: str) -> str | None:
        if self.peek(*words):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise TemplateError(f"{word!r} is missing")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"not understood: {self.tokens[self.at][1]!r}")

    def parse(self) -> tuple:
        self.depth += 1
        if self.depth > _DEPTH:
            raise TemplateError("nested too deep")
        found = self._either()
        if self.take("if"):
            condition = self._either()
            self.need("else")
            found = ("choose", condition, found, self.parse())
        self.depth -= 1
        return found

    def _either(self) -> tuple:
        left = self._both()
        while self.take("or"):
            left = ("or", left, self._both())
        return left

    def _both(self) -> tuple:
        left = self._negated()
        while self.take("and"):
            left = ("and", left, self._negated())
        return left

    def _negated(self) -> tuple:
        odd = False
        while self.take("not"):
            odd = not odd
        found = self._binary(0)
        return ("not", found) if odd else found

    def _binary(self, level: int) -> tuple:
        if level == len(_LEVELS):
            return self._filtered()
        left = self._binary(level + 1)
        while True:
            how = self.take(*_LEVELS[level])
            if not how and level == 0 and self.peek("not") and self.tokens[self.at + 1:self.at + 2] == [("name", "in")]:
                self.at, how = self.at + 2, "not in"
            if not how:
                return left
            left = ("apply", how, left, self._binary(level + 1))

    def _filtered(self) -> tuple:
        found = self._placed()
        while self.take("|"):
            name, others = self.name(), []
            if self.take("("):
                while not self.take(")"):
                    others.append(self.parse())
                    if not self.peek(")"):
                        self.need(",")
            found = ("filter", name, found, *others)
        return found

    def _placed(self) -> tuple:
        found = self._single()
        while True:
            if self.take("."):
                found = ("apply", "item", found, ("constant", self.name()))
            elif self.take("["):
                found = ("apply", "item", found, self.parse())
                self.need("]")
            else:
                return found

    def _single(self) -> tuple:
        if self.take("("):
            found = self.parse()
            self.need(")")
            return found
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.parse())
                if not self.peek("]"):
                    self.need(",")
            return ("list", *items)
        if self.take("-"):
            return ("apply", "-", ("constant", 0), self._placed())
        if self.at >= len(self.tokens) or self.tokens[self.at][0] == "sign":
            raise TemplateError("a value is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return ("constant", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return ("constant", _number(int(value[:25])))
        if value in _WORDS:
            return ("constant", _WORDS[value])
        if value in _RESERVED and value != "loop":
            raise TemplateError(f"{value!r} can't stand there")
        return ("name", value)


def _whole(source: str) -> tuple:
    parser = _Expression(source)
    found = parser.parse()
    parser.end()
    return found


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    root: list[tuple] = []
    # Open blocks: kind, where statements go, and what else the block needs.
    open_: list[list] = [["", root]]
    at, strip = 0, False

    def text(value: str, strip_end: bool) -> None:
        value = value.lstrip() if strip else value
        value = value.rstrip() if strip_end else value
        if value:
            open_[-1][1].append(("text", value))

    for mark in _MARK.finditer(source):
        text(source[at:mark.start()], mark[0][2] == "-" and mark[0][1] != "#")
        at, strip = mark.end(), mark[0][-3] == "-" and mark[0][1] != "#"
        if mark["out"] is not None:
            open_[-1][1].append(("out", _whole(mark["out"])))
            continue
        if mark["do"] is None:
            continue
        parser = _Expression(mark["do"])
        word = parser.name()
        kind = open_[-1][0]
        if word == "if":
            branch = (parser.parse(), [])
            node = ("if", [branch], [])
            open_[-1][1].append(node)
            open_.append(["if", branch[1], node])
        elif word == "elif" and kind == "if":
            branch = (parser.parse(), [])
            open_[-1][2][1].append(branch)
            open_[-1][1] = branch[1]
        elif word == "else" and kind == "if":
            open_[-1][:2] = ["else", open_[-1][2][2]]
        elif word == "for":
            name = _settable(parser.name())
            parser.need("in")
            node = ("for", name, parser.parse(), [])
            open_[-1][1].append(node)
            open_.append(["for", node[3]])
        elif word == "generation":
            if any(o[0] == "generation" for o in open_):
                raise TemplateError("generation inside generation")
            node = ("generation", [])
            open_[-1][1].append(node)
            open_.append(["generation", node[1]])
        elif word == "set":
            name = _settable(parser.name())
            parser.need("=")
            open_[-1][1].append(("set", name, parser.parse()))
        elif word == {"if": "endif", "else": "endif", "for": "endfor", "generation": "endgeneration"}.get(kind):
            open_.pop()
        else:
            raise TemplateError(f"{word!r} can't stand there")
        parser.end()
        if len(open_) > _DEPTH:
            raise TemplateError("nested too deep")
    rest = source[at:]
    if re.search(r"\{\{|\{%", rest):
        raise TemplateError("a mark isn't closed")
    text(rest, False)
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]!r} isn't closed")
    return root


def _settable(name: str) -> str:
    if name in _RESERVED:
        raise TemplateError(f"{name!r} can't be set")
    return name


class Template:
    """A compiled template. ``constants`` are folded into it; ``stream`` names
    the list that is read as a stream; ``names`` are given when rendering."""

    def __init__(self, source: str, stream: str = "messages", names: Iterable[str] = (), constants: dict[str, Any] | None = None,
                 filters: dict[str, Callable] | None = None):
        self.stream, self._filters, self._constants = stream, FILTERS | (filters or {}), constants or {}
        self._names = {stream, *names}
        self._stream_loops = 0
        self.tree = self._fold_all(parse(source), frozenset(self._constants))
        self._check(self.tree, set(self._names), outside=True)
        #: Whether each item of the stream is rendered from itself alone.
        self.local = len(self.tree) == 1 and self.tree[0][0] == "for" and self.tree[0][2] == ("name", stream) and not _uses(self.tree[0][3], "loop")
        self._run = self._block(self.tree)

    def render(self, stream: Iterable[dict], **values: Any) -> Iterator[Piece]:
        return self._run({**values, self.stream: iter(stream)}, False)

    # Folding. ``known`` are the constants that no ``set`` or loop hides.

    def _fold(self, node: tuple, known: frozenset) -> tuple:
        kind = node[0]
        if kind == "name":
            return ("constant", self._constants[node[1]]) if node[1] in known else node
        if kind == "constant":
            return node
        head = 2 if kind in ("apply", "filter") else 1
        node = (*node[:head], *(self._fold(x, known) for x in node[head:]))
        given = node[head:]
        if kind in ("and", "or", "choose") and given[0][0] == "constant":
            truth = bool(given[0][1])
            return given[0 if truth else 1] if kind == "or" else given[1 if truth else 0] if kind == "and" else given[1 if truth else 2]
        if all(x[0] == "constant" for x in given) and (kind != "filter" or node[1] in self._filters):
            try:
                return ("constant", self._value(node)({}))
            except TemplateError:
                return node  # an error only where it is reached
        return node

    def _fold_all(self, body: list[tuple], known: frozenset) -> list[tuple]:
        known -= _set_names(body)
        out: list[tuple] = []
        for node in body:
            kind = node[0]
            if kind == "out":
                value = self._fold(node[1], known)
                folded = [("text", _text(value[1]))] if value[0] == "constant" else [("out", value)]
            elif kind == "set":
                folded = [("set", node[1], self._fold(node[2], known))]
            elif kind == "generation":
                folded = [("generation", self._fold_all(node[1], known))]
            elif kind == "for":
                over = self._fold(node[2], known)
                folded = [] if over == ("constant", []) else [("for", node[1], over, self._fold_all(node[3], known - {node[1]}))]
            elif kind == "if":
                folded = self._fold_if(node, known)
            else:
                folded = [node]
            for x in folded:
                if x[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + x[1])
                elif x != ("text", ""):
                    out.append(x)
        return out

    def _fold_if(self, node: tuple, known: frozenset) -> list[tuple]:
        branches = []
        for condition, body in node[1]:
            condition = self._fold(condition, known)
            if condition[0] != "constant":
                branches.append((condition, self._fold_all(body, known)))
            elif condition[1]:
                last = self._fold_all(body, known)
                break
        else:
            last = self._fold_all(node[2], known)
        return [("if", branches, last)] if branches else last

    def _check(self, body: list[tuple], names: set[str], outside: bool) -> None:
        """Every name is set, and the stream is read by one outer loop."""
        def value(node: tuple) -> None:
            if node[0] == "name" and (node[1] not in names or node[1] == self.stream):
                raise TemplateError(f"{node[1]!r} isn't set" if node[1] != self.stream else "the stream is read by one outer loop only")
            if node[0] == "filter" and node[1] not in self._filters:
                raise TemplateError(f"no filter {node[1]!r}")
            for x in node[1:]:
                if isinstance(x, tuple):
                    value(x)

        for node in body:
            if node[0] == "out":
                value(node[1])
            elif node[0] == "set":
                value(node[2])
                names.add(node[1])
            elif node[0] == "generation":
                self._check(node[1], names, False)
            elif node[0] == "if":
                for condition, _ in node[1]:
                    value(condition)
                for inner in [*(b for _, b in node[1]), node[2]]:
                    self._check(inner, set(names), False)
            elif node[0] == "for":
                if node[2] == ("name", self.stream):
                    self._stream_loops += 1
                    if not outside or self._stream_loops > 1:
                        raise TemplateError("the stream is read by one outer loop only")
                else:
                    value(node[2])
                self._check(node[3], names | {node[1], "loop"}, False)

    # Closures.

    def _value(self, node: tuple) -> Callable[[dict], Any]:
        kind = node[0]
        if kind == "constant":
            constant = node[1]
            return lambda env: constant
        if kind == "name":
            name = node[1]
            return lambda env: env.get(name)
        given = [self._value(x) for x in node[2 if kind in ("apply", "filter") else 1:]]
        if kind == "list":
            return lambda env: [g(env) for g in given]
        first = given[0]
        if kind == "not":
            return lambda env: not first(env)
        if kind == "filter":
            how, others = self._filters.get(node[1]), given[1:]
            return lambda env: how(first(env), *[g(env) for g in others])
        second = given[1]
        if kind == "apply":
            how = _OPERATORS[node[1]]
            return lambda env: how(first(env), second(env))
        if kind == "and":
            return lambda env: first(env) and second(env)
        if kind == "or":
            return lambda env: first(env) or second(env)
        third = given[2]
        return lambda env: second(env) if first(env) else third(env)

    def _block(self, body: list[tuple]) -> Callable[[dict, bool], Iterator[Piece]]:
        steps = [self._step(node) for node in body]

        def run(env: dict, learn: bool) -> Iterator[Piece]:
            for step in steps:
                yield from step(env, learn)
        return run

    def _step(self, node: tuple) -> Callable[[dict, bool], Iterable[Piece]]:
        kind = node[0]
        if kind == "text":
            text = node[1]
            return lambda env, learn: ((text, learn),)
        if kind == "out":
            value = self._value(node[1])
            return lambda env, learn: ((_text(value(env)), learn),)
        if kind == "generation":
            inner = self._block(node[1])
            return lambda env, learn: inner(env, True)
        if kind == "set":
            name, value = node[1], self._value(node[2])

            def put(env: dict, learn: bool) -> Iterable[Piece]:
                env[name] = value(env)
                return ()
            return put
        if kind == "if":
            branches = [(self._value(c), self._block(b)) for c, b in node[1]]
            other = self._block(node[2])

            def choose(env: dict, learn: bool) -> Iterable[Piece]:
                for condition, inner in branches:
                    if condition(env):
                        return inner(dict(env), learn)
                return other(dict(env), learn)
            return choose
        name, over, inner, streams = node[1], self._value(node[2]), self._block(node[3]), node[2] == ("name", self.stream)

        def loop(env: dict, learn: bool) -> Iterator[Piece]:
            items = over(env)
            if not streams and not isinstance(items, list):
                raise TemplateError(f"no loop over a {type(items).__name__}")
            items, nothing, index = iter(items), object(), 0
            item = next(items, nothing)
            while item is not nothing:
                following = next(items, nothing)
                yield from inner({**env, name: item, "loop": {"index0": index, "first": not index, "last": following is nothing}}, learn)
                if streams and following is not nothing:
                    yield None
                item, index = following, index + 1
        return loop


def _set_names(body: list[tuple]) -> frozenset:
    """Names that some ``set`` in the body gives another value."""
    out = set()
    for node in body:
        if node[0] == "set":
            out.add(node[1])
        for x in node[1:]:
            if isinstance(x, list):
                out |= _set_names([y for b in x for y in (b[1] if node[0] == "if" and x is node[1] else [b])])
    return frozenset(out)


def _uses(tree: Any, name: str) -> bool:
    if isinstance(tree, (tuple, list)):
        return tuple(tree) == ("name", name) or any(_uses(x, name) for x in tree)
    return False
