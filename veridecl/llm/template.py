"""A compiler for a small sandboxed template language: text to syntax tree, constants folded, tree to Python closures.

Text stands for itself; ``{{ expression }}`` is output; ``{% for x in messages %}``, ``{% if %}``, ``{% elif %}``,
``{% else %}``, ``{% endif %}``, ``{% endfor %}`` and ``{% generation %} ... {% endgeneration %}`` are the statements.
Expressions: strings, integers, true, false, names, fields of names (``x.role``, ``loop.first``, ``loop.last``,
``loop.index``), ``==``, ``!=``, ``+``, ``and``, ``or``, ``not``, parentheses and filters (``x.text|escape``). Nothing
else can be reached from a template: fields are looked up in mappings only, and filters in a fixed table.

A compiled template is a generator of pieces (text, generated); messages are taken from an iterator one ahead, so a
conversation of any length is rendered in the memory of two messages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

Piece = tuple[str, bool]
Scope = dict
_TOKEN = re.compile(r"""\s*(?:(?P<str>'[^'\\]*(?:\\.[^'\\]*)*'|"[^"\\]*(?:\\.[^"\\]*)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+|.()]))""", re.S)
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*-?%\}", re.S)
_UNQUOTE = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """A template that doesn't follow the grammar, or names what isn't there."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Unary:
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Output:
    of: object


@dataclass(frozen=True)
class If:
    test: object
    body: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Expression:
    """A parser by recursive descent of one expression."""

    def __init__(self, source: str, filters: dict[str, Callable]) -> None:
        self.tokens, self.at, self.filters = [], 0, filters
        while source[self.at :].strip():
            m = _TOKEN.match(source, self.at)
            if not m:
                raise TemplateError(f"can't read {source[self.at :]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            self.at = m.end()
        self.at = 0

    def parse(self):
        found = self._or()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def _next(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][1] in texts and self.tokens[self.at][0] != "str":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _chain(self, part: Callable, *ops: str):
        left = part()
        while op := self._next(*ops):
            left = Binary(op, left, part())
        return left

    def _or(self):
        return self._chain(self._and, "or")

    def _and(self):
        return self._chain(self._not, "and")

    def _not(self):
        return Unary(self._not()) if self._next("not") else self._chain(self._sum, "==", "!=")

    def _sum(self):
        return self._chain(self._filtered, "+")

    def _filtered(self):
        found = self._atom()
        while self._next("|"):
            name = self._name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            found = Filter(name, found)
        return found

    def _name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def _atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too soon")
        if self._next("("):
            found = self._or()
            if not self._next(")"):
                raise TemplateError("a parenthesis is not closed")
            return found
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _UNQUOTE.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(text))
        if kind != "name" or text in ("and", "or", "not"):
            raise TemplateError(f"unexpected {text!r}")
        if text in ("true", "false"):
            return Const(text == "true")
        found = Name(text)
        while self._next("."):
            found = Field(found, self._name())
        return found


def parse(source: str, filters: dict[str, Callable]) -> tuple:
    """The syntax tree of a template."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2]))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    read = lambda text: _Expression(text, filters).parse()
    position = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal position
        body = []
        while position < len(parts):
            kind, text = parts[position]
            position += 1
            word, _, rest = text.partition(" ") if kind == "tag" else ("", "", "")
            if kind == "text":
                body.append(Output(Const(text)))
            elif kind == "out":
                body.append(Output(read(text)))
            elif word in ends:
                return tuple(body), text
            elif word == "if":
                body.append(branch(rest))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"can't read {text!r}")
                body.append(For(m[1], read(m[2]), block("endfor")[0]))
            elif word == "generation":
                body.append(Generation(block("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected {text!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(body), ""

    def branch(test: str) -> If:
        body, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return If(read(test), body, (branch(end[4:]),))
        return If(read(test), body, block("endif")[0] if end == "else" else ())

    return block()[0]


def fold(node, filters: dict[str, Callable]):
    """The tree with what is constant worked out, branches that can't be taken left out, and texts in a row joined."""
    again = lambda x: fold(x, filters)
    if isinstance(node, tuple):
        out: list = []
        for part in map(again, node):
            if isinstance(part, If) and isinstance(part.test, Const):
                more = list(part.body if part.test.value else part.other)
            else:
                more = [part]
            for x in more:
                texts = [y.of.value for y in (*out[-1:], x) if isinstance(y, Output) and isinstance(y.of, Const)]
                if len(texts) == 2:
                    out[-1] = Output(Const(_shown(texts[0]) + _shown(texts[1])))
                elif not (isinstance(x, Output) and x.of == Const("")):
                    out.append(x)
        return tuple(out)
    if isinstance(node, Output):
        return Output(again(node.of))
    if isinstance(node, If):
        return If(again(node.test), again(node.body), again(node.other))
    if isinstance(node, For):
        return For(node.name, again(node.over), again(node.body))
    if isinstance(node, Generation):
        return Generation(again(node.body))
    if isinstance(node, Field):
        return Field(again(node.of), node.name)
    if isinstance(node, Unary):
        of = again(node.of)
        return Const(not of.value) if isinstance(of, Const) else Unary(of)
    if isinstance(node, Filter):
        of = again(node.of)
        return Const(filters[node.name](_shown(of.value))) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Binary):
        left, right = again(node.left), again(node.right)
        if isinstance(left, Const) and (isinstance(right, Const) or node.op in ("and", "or") and bool(left.value) == (node.op == "or")):
            return Const(_apply(node.op, left.value, lambda: right.value))
        return Binary(node.op, left, right)
    return node


def _shown(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _apply(op: str, left: object, right: Callable[[], object]) -> object:
    if op == "and":
        return left and right()
    if op == "or":
        return left or right()
    if op == "==":
        return left == right()
    if op == "!=":
        return left != right()
    other = right()
    return left + other if isinstance(left, int) and isinstance(other, int) else _shown(left) + _shown(other)


def _value(node, filters: dict[str, Callable]) -> Callable[[Scope], object]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        return lambda scope, n=node.name: scope.get(n)
    if isinstance(node, Field):
        of = _value(node.of, filters)

        def field(scope: Scope, name=node.name) -> object:
            found = of(scope)
            return found.get(name) if isinstance(found, dict) else None

        return field
    if isinstance(node, Unary):
        of = _value(node.of, filters)
        return lambda scope: not of(scope)
    if isinstance(node, Filter):
        of, change = _value(node.of, filters), filters[node.name]
        return lambda scope: change(_shown(of(scope)))
    left, right = _value(node.left, filters), _value(node.right, filters)
    return lambda scope, op=node.op: _apply(op, left(scope), lambda: right(scope))


def _statement(node, filters: dict[str, Callable]) -> Callable[[Scope, bool], Iterator[Piece]]:
    if isinstance(node, tuple):
        parts = [_statement(x, filters) for x in node]

        def run(scope: Scope, made: bool) -> Iterator[Piece]:
            for part in parts:
                yield from part(scope, made)

        return run
    if isinstance(node, Output):
        value = _value(node.of, filters)

        def put(scope: Scope, made: bool) -> Iterator[Piece]:
            yield _shown(value(scope)), made

        return put
    if isinstance(node, If):
        test, body, other = _value(node.test, filters), _statement(node.body, filters), _statement(node.other, filters)
        return lambda scope, made: body(scope, made) if test(scope) else other(scope, made)
    if isinstance(node, Generation):
        body = _statement(node.body, filters)
        return lambda scope, made: body(scope, True)
    over, body, name = _value(node.over, filters), _statement(node.body, filters), node.name

    def loop(scope: Scope, made: bool) -> Iterator[Piece]:
        rest, index = iter(over(scope) or ()), 0
        missing = object()
        now = next(rest, missing)
        while now is not missing:
            following = next(rest, missing)
            yield from body(scope | {name: now, "loop": {"first": index == 0, "last": following is missing, "index": index + 1}}, made)
            now, index = following, index + 1

    return loop


def compile_template(source: str, filters: dict[str, Callable[[str], str]]) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages (mappings) to the pieces of the rendered text, each with whether it lies in a generation."""
    run = _statement(fold(parse(source, filters), filters), filters)
    return lambda messages, **names: run({"messages": messages, **names}, False)
