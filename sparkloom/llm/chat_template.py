"""A small sandboxed template language for conversations, compiled to Python closures.

``{{ expression }}``, ``{% for x in list %}``, ``{% if %}/{% elif %}/{% else %}``, ``{% set x = expression %}``, ``{% generation %}`` around
what a model is to learn, and ``{# comments #}``; a ``-`` inside a mark strips the white space beside it. Expressions have
literals, names, ``a.key``, ``a[key]``, ``not and or``, comparisons, ``in``, ``+ ~ - %``, ``x if c else y``, ``is [not] defined|none``, the
filters of ``FILTERS`` and ``raise_exception(text)``. Keys are looked up in dicts and lists only, never in Python objects, and nothing
else can be called. Names set inside a loop end with its round, as loops do. Nesting and the length of a value are bounded.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

MOST_NESTED, MOST_CHARS = 64, 1 << 28
ESCAPE = "\\"
_MARK = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+~%<>()\[\].,|=]))""", re.S)
_UNSET = object()


class TemplateError(ValueError):
    """A template that cannot be compiled, or that a conversation does not fit."""


@dataclass
class Node:
    """``kind`` and parts; a constant is ``Node("const", [value])``."""

    kind: str
    parts: list = field(default_factory=list)


def _const(value) -> Node:
    return Node("const", [value])


# -- parsing


class _Expression:
    """Parses one expression by precedence."""

    _LEVELS = [("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in", "not in"), ("+", "-", "~"), ("%",)]

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.nested = 0, 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, *values: str) -> str:
        if (found := self.take(*values)) is None:
            raise TemplateError(f"{' or '.join(values)} expected")
        return found

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Node:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> Node:
        self.nested += 1
        if self.nested > MOST_NESTED:
            raise TemplateError("nested too deep")
        node = self.level(0)
        if self.take("if"):
            test = self.level(0)
            node = Node("choice", [test, node, self.choice() if self.take("else") else _const("")])
        self.nested -= 1
        return node

    def level(self, n: int) -> Node:
        if n == len(self._LEVELS):
            return self.unary()
        if n == 2 and self.take("not"):
            return Node("not", [self.level(2)])
        node = self.level(n + 1)
        while True:
            sign = self.take(*(s for s in self._LEVELS[n] if " " not in s))
            if sign is None and n == 2 and self.peek("not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                sign = "not in"
            if sign is None:
                return node
            node = Node("op", [sign, node, self.level(n + 1)])

    def unary(self) -> Node:
        node = Node("op", ["-", _const(0), self.unary()]) if self.take("-") else self.atom()
        while True:
            if self.take("."):
                node = Node("item", [node, _const(self.name())])
            elif self.take("["):
                node = Node("item", [node, self.choice()])
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name}")
                node = Node("filter", [name, node, *self.arguments()])
            elif self.take("is"):
                other = bool(self.take("not"))
                test = Node("is", [self.need("defined", "none"), node])
                node = Node("not", [test]) if other else test
            else:
                return node

    def arguments(self) -> list[Node]:
        found = []
        if self.take("("):
            while not self.take(")"):
                found.append(self.choice())
                if not self.peek(")"):
                    self.need(",")
        return found

    def atom(self) -> Node:
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return _const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return _const(int(value))
        if kind == "name":
            if value in _CONSTANTS:
                return _const(_CONSTANTS[value])
            if value == "raise_exception":
                return Node("raise", self.arguments())
            return Node("name", [value])
        raise TemplateError(f"unexpected {value!r}")


_CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


def parse(source: str) -> list[Node]:
    """The syntax tree of a template."""
    pieces, at, strip = [], 0, False
    for m in [*_MARK.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        if m and (m[1] or m[4] or m[7]):
            text = text.rstrip()
        if text:
            pieces.append(("text", text))
        if m:
            at, strip = m.end(), bool(m[3] or m[6] or m[8])
            if m[2] is not None or m[5] is not None:
                pieces.append(("show", m[2]) if m[2] is not None else ("do", m[5].strip()))
    if any("{%" in p[1] or "{{" in p[1] for p in pieces if p[0] == "text"):
        raise TemplateError("a mark is not closed")
    nodes, rest = _block(pieces, 0, (), 0)
    return nodes if rest == len(pieces) else []


def _block(pieces: list, at: int, ends: tuple[str, ...], nested: int) -> tuple[list[Node], int]:
    """Nodes up to one of the marks that end them."""
    if nested > MOST_NESTED:
        raise TemplateError("nested too deep")
    nodes: list[Node] = []
    while at < len(pieces):
        kind, text = pieces[at]
        word, _, rest = text.strip().partition(" ")
        if kind == "text":
            nodes.append(Node("text", [text]))
        elif kind == "show":
            nodes.append(Node("show", [_Expression(text).whole()]))
        elif word in ends:
            return nodes, at
        elif word == "set":
            name, _, value = rest.partition("=")
            nodes.append(Node("set", [_plain_name(name), _Expression(value).whole()]))
        elif word == "generation":
            body, at = _block(pieces, at + 1, ("endgeneration",), nested + 1)
            nodes.append(Node("generation", [body]))
        elif word == "for":
            name, _, value = rest.partition(" in ")
            body, at = _block(pieces, at + 1, ("endfor",), nested + 1)
            nodes.append(Node("for", [_plain_name(name), _Expression(value).whole(), body]))
        elif word == "if":
            tests = []
            while word in ("if", "elif"):
                test = _Expression(rest).whole()
                body, at = _block(pieces, at + 1, ("elif", "else", "endif"), nested + 1)
                tests.append((test, body))
                word, _, rest = pieces[at][1].partition(" ")
            other: list[Node] = []
            if word == "else":
                other, at = _block(pieces, at + 1, ("endif",), nested + 1)
            nodes.append(Node("if", [tests, other]))
        else:
            raise TemplateError(f"unknown statement {text!r}")
        at += 1
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return nodes, at


def _plain_name(text: str) -> str:
    name = text.strip()
    if not re.fullmatch(r"[A-Za-z_]\w*", name) or name in _CONSTANTS or name in ("loop", "messages"):
        raise TemplateError(f"{name!r} cannot be set")
    return name


# -- values


def _text(value) -> str:
    if value is _UNSET or value is None:
        return ""
    out = ("True" if value else "False") if isinstance(value, bool) else str(value)
    if len(out) > MOST_CHARS:
        raise TemplateError("a value is too long")
    return out


def _add(a, b):
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


_OPERATORS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b,
    "not in": lambda a, b: a not in b, "+": _add, "~": lambda a, b: _text(a) + _text(b), "-": operator.sub,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": len,
    "default": lambda v, other="": other if v is _UNSET or v is None else v, "escape": None,
}


def _item(value, key):
    if isinstance(value, dict):
        return value.get(key, _UNSET)
    if isinstance(value, list) and isinstance(key, int) and -len(value) <= key < len(value):
        return value[key]
    return _UNSET


class Escape:
    """Makes control strings in a text harmless, reversibly: a mark after the first character of each, and twice where it stands itself."""

    def __init__(self, controls: list[str]):
        if any(len(c) < 2 or ESCAPE in c for c in controls):
            raise TemplateError("control strings have two characters or more, and no backslash")
        self.starts = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls)) if controls else None

    def escape(self, text: str) -> str:
        text = text.replace(ESCAPE, ESCAPE * 2)
        return self.starts.sub(lambda m: m[0] + ESCAPE, text) if self.starts else text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if ESCAPE in text else text


# -- folding and closures


class Output:
    """What a template has written so far, and the ranges of it between generation marks."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def text(self) -> str:
        return "".join(self.parts)


class Template:
    """A compiled template; ``controls`` are the strings that its ``escape`` filter keeps out of texts."""

    def __init__(self, source: str, controls: list[str] | None = None, **constants):
        self.controls, self.constants = Escape(controls or []), constants
        self.nodes = self._fold_all(parse(source))
        self._run = self._sequence(self.nodes)
        loops = [i for i, n in enumerate(self.nodes) if n.kind == "for" and n.parts[1].kind == "name" and n.parts[1].parts == ["messages"]]
        self.parts = None
        if len(loops) == 1 and not self._names(self.nodes[: loops[0]] + self.nodes[loops[0] + 1 :] + self.nodes[loops[0]].parts[2]) & {"messages", "loop.last", "loop.length"} and not any(n.kind == "set" for n in self.nodes):
            loop = self.nodes[loops[0]]
            self.parts = self._sequence(self.nodes[: loops[0]]), self._loop(loop), self._sequence(self.nodes[loops[0] + 1 :])

    def render(self, messages: list[dict]) -> Output:
        """A whole conversation."""
        out = Output()
        self._run({"messages": messages}, out)
        return out

    def render_part(self, messages: list[dict], done: int, last: bool) -> Output:
        """Some consecutive messages of a conversation of which ``done`` came before; only templates with ``parts`` can."""
        out, (head, loop, tail) = Output(), self.parts
        if not done:
            head({}, out)
        loop({"messages": messages, "__done": done}, out)
        if last:
            tail({}, out)
        return out

    def _names(self, nodes) -> set[str]:
        """Names that some nodes read; fields of ``loop`` with it."""
        found: set[str] = set()
        for n in nodes:
            if isinstance(n, Node):
                if n.kind == "item" and n.parts[0].kind == "name" and n.parts[0].parts == ["loop"]:
                    found.add(f"loop.{n.parts[1].parts[0]}" if n.parts[1].kind == "const" else "loop.last")
                elif n.kind == "name":
                    found.add(n.parts[0])
                found |= self._names(n.parts)
            elif isinstance(n, (list, tuple)):
                found |= self._names(n)
        return found

    def _fold_all(self, nodes: list[Node]) -> list[Node]:
        """Constant expressions computed, decided branches chosen, neighbouring texts joined."""
        out: list[Node] = []
        for n in nodes:
            if n.kind == "show":
                e = self._fold(n.parts[0])
                n = Node("text", [_text(e.parts[0])]) if e.kind == "const" else Node("show", [e])
            elif n.kind == "set":
                n = Node("set", [n.parts[0], self._fold(n.parts[1])])
            elif n.kind == "generation":
                n = Node("generation", [self._fold_all(n.parts[0])])
            elif n.kind == "for":
                n = Node("for", [n.parts[0], self._fold(n.parts[1]), self._fold_all(n.parts[2])])
            elif n.kind == "if":
                tests, other = [], self._fold_all(n.parts[1])
                for test, body in ((self._fold(t), self._fold_all(b)) for t, b in n.parts[0]):
                    if test.kind != "const":
                        tests.append((test, body))
                    elif test.parts[0]:
                        other = body
                        break
                if not tests:
                    out += other
                    continue
                n = Node("if", [tests, other])
            out.append(n)
        joined: list[Node] = []
        for n in out:
            if n.kind == "text" and joined and joined[-1].kind == "text":
                joined[-1] = Node("text", [joined[-1].parts[0] + n.parts[0]])
            else:
                joined.append(n)
        return joined

    def _fold(self, n: Node) -> Node:
        if n.kind == "name" and n.parts[0] in self.constants:
            return _const(self.constants[n.parts[0]])
        parts = [self._fold(p) if isinstance(p, Node) else p for p in n.parts]
        n = Node(n.kind, parts)
        if n.kind in ("op", "not", "filter", "choice", "item") and all(p.kind == "const" for p in parts if isinstance(p, Node)):
            return _const(self._value(n)({}))
        if n.kind == "choice" and parts[0].kind == "const":
            return parts[1] if parts[0].parts[0] else parts[2]
        return n

    def _value(self, n: Node) -> Callable:
        """The closure of an expression: scope -> value."""
        if n.kind == "const":
            value = n.parts[0]
            return lambda scope: value
        if n.kind == "name":
            name = n.parts[0]
            return lambda scope: scope.get(name, _UNSET)
        if n.kind == "item":
            of, key = map(self._value, n.parts)
            return lambda scope: _item(of(scope), key(scope))
        if n.kind == "not":
            of = self._value(n.parts[0])
            return lambda scope: not _true(of(scope))
        if n.kind == "is":
            of, none = self._value(n.parts[1]), n.parts[0] == "none"
            return (lambda scope: of(scope) is None) if none else (lambda scope: of(scope) is not _UNSET)
        if n.kind == "choice":
            test, yes, no = map(self._value, n.parts)
            return lambda scope: yes(scope) if _true(test(scope)) else no(scope)
        if n.kind == "raise":
            said = self._value(n.parts[0]) if n.parts else lambda scope: "raise_exception"

            def stop(scope):
                raise TemplateError(_text(said(scope)))

            return stop
        if n.kind == "filter":
            name, (of, *more) = n.parts[0], map(self._value, n.parts[1:])
            run = self.controls.escape if name == "escape" else FILTERS[name]
            return (lambda scope: run(_text(of(scope)))) if name == "escape" else (lambda scope: run(of(scope), *(m(scope) for m in more)))
        sign, a, b = n.parts[0], self._value(n.parts[1]), self._value(n.parts[2])
        if sign in ("and", "or"):
            both = sign == "and"
            return lambda scope: b(scope) if _true(x := a(scope)) == both else x
        if sign == "%":
            return lambda scope: _remainder(a(scope), b(scope))
        run = _OPERATORS[sign]

        def apply(scope):
            try:
                return run(a(scope), b(scope))
            except TypeError as error:
                raise TemplateError(str(error)) from None

        return apply

    def _sequence(self, nodes: list[Node]) -> Callable:
        steps = [self._statement(n) for n in nodes]

        def run(scope, out):
            for step in steps:
                step(scope, out)

        return steps[0] if len(steps) == 1 else run

    def _statement(self, n: Node) -> Callable:
        """The closure of a statement: (scope, output) -> None."""
        if n.kind == "text":
            text = n.parts[0]
            return lambda scope, out: out.write(text)
        if n.kind == "show":
            of = self._value(n.parts[0])
            return lambda scope, out: out.write(_text(of(scope)))
        if n.kind == "set":
            name, of = n.parts[0], self._value(n.parts[1])
            return lambda scope, out: scope.__setitem__(name, of(scope))
        if n.kind == "for":
            return self._loop(n)
        if n.kind == "generation":
            body = self._sequence(n.parts[0])

            def marked(scope, out):
                start = out.length
                body(scope, out)
                out.spans.append((start, out.length))

            return marked
        tests = [(self._value(t), self._sequence(b)) for t, b in n.parts[0]]
        other = self._sequence(n.parts[1])

        def choose(scope, out):
            for test, body in tests:
                if _true(test(scope)):
                    return body(scope, out)
            return other(scope, out)

        return choose

    def _loop(self, n: Node) -> Callable:
        name, of, body = n.parts[0], self._value(n.parts[1]), self._sequence(n.parts[2])

        def rounds(scope, out):
            rows = of(scope)
            if not isinstance(rows, list):
                raise TemplateError("a loop runs over a list")
            done = scope.get("__done", 0)
            for i, row in enumerate(rows, done):
                loop = {"index0": i, "index": i + 1, "first": i == 0, "last": i == done + len(rows) - 1, "length": done + len(rows)}
                body({**scope, "__done": 0, name: row, "loop": loop}, out)

        return rounds


def _true(value) -> bool:
    return value is not _UNSET and bool(value)


def _remainder(a, b) -> int:
    if not isinstance(a, int) or not isinstance(b, int) or not b:
        raise TemplateError("% takes whole numbers")
    return a % b


@cache
def compiled(source: str, controls: tuple[str, ...]) -> Template:
    """The template of a source, compiled once in a worker."""
    return Template(source, list(controls))
