"""A small sandboxed template language for chat formats, compiled to closures.

    text {{ expression }} {% if a %}..{% elif b %}..{% else %}..{% endif %}
    {% set name = expression %} {% generation %}..{% endgeneration %}
    {% for message in messages %}..{% endfor %}     {# comment #}

A dash inside a tag (``{%-``, ``-%}``) drops the white space beside it.
Expressions have strings, whole numbers, true, false, none, names, ``a.b`` and
``a['b']`` (keys of plain mappings only), ``not``, ``and``, ``or``, comparisons,
``in``, ``+``, ``~`` (joins as text) and filters after ``|``. There are no
calls, no attributes of objects and no loops but the one over the messages, so
a template can neither reach the host nor run without end.

A template is parsed to a syntax tree, constant parts are folded, and each node
becomes a Python closure. The loop over the messages splits a template into
what stands before, inside and behind it, so a conversation is rendered message
by message and is never held as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


class TemplateError(ValueError):
    """The template is not in the language."""


def escape(text: str) -> str:
    """Breaks every ``<|``: one more backslash between its two characters."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def escape_line(text: str) -> str:
    """``escape`` for a text that must stay on one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(), "lower": lambda v: _text(v).lower(), "upper": lambda v: _text(v).upper(),
    "length": lambda v: len(_text(v)), "escape": lambda v: escape(_text(v)),
    "escape_line": lambda v: escape_line(_text(v)),
}
COMPARE: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: _text(a) in _text(b),
    "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b),
}
CONSTANTS = {"true": True, "false": False, "none": None}
WORDS = {"and", "or", "not", "in", *CONSTANTS}


# -- syntax tree ----------------------------------------------------------------

@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Key:
    of: object
    key: object


@dataclass
class Unary:  # not, or a filter
    name: str
    of: object


@dataclass
class Binary:
    name: str
    left: object
    right: object


@dataclass
class Output:
    value: object


@dataclass
class Set:
    name: str
    value: object


@dataclass
class If:
    test: object
    then: list
    other: list


@dataclass
class Generation:
    body: list


@dataclass
class Loop:
    name: str
    body: list


# -- parsing --------------------------------------------------------------------

_TAG = re.compile(r"\{#.*?#\}|\{%-?(.*?)-?%\}|\{\{-?(.*?)-?\}\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~|.\[\]()])|(\S))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens = []
        at = 0
        source = source.strip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            string, number, name, sign, bad = found.groups()
            if bad is not None:
                raise TemplateError(f"unexpected {bad!r} in {source!r}")
            if string is not None:
                body = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), string[1:-1], flags=re.S)
                self.tokens.append(("const", body))
            elif number is not None:
                self.tokens.append(("const", int(number)))
            else:
                self.tokens.append(("name", name) if name is not None else ("sign", sign))
            at = found.end()
        self.tokens.append(("end", None))
        self.source, self.at = source, 0

    def whole(self):
        node = self.either()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"cannot read {self.source!r}")
        return node

    def take(self, *wanted: str) -> str | None:
        kind, value = self.tokens[self.at]
        if kind != "const" and value in wanted:
            self.at += 1
            return value
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing in {self.source!r}")

    def either(self):
        node = self.both()
        while self.take("or"):
            node = Binary("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = Binary("and", node, self.negated())
        return node

    def negated(self):
        return Unary("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.joined()
        while sign := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            node = Binary(sign, node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while sign := self.take("+", "~"):
            node = Binary(sign, node, self.filtered())
        return node

    def filtered(self):
        node = self.single()
        while self.take("|"):
            kind, name = self.tokens[self.at]
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = Unary(name, node)
        return node

    def single(self):
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            node = Const(value)
        elif kind == "name" and value in CONSTANTS:
            node = Const(CONSTANTS[value])
        elif kind == "name" and value not in WORDS:
            node = Name(value)
        elif value == "(":
            node = self.either()
            self.need(")")
        else:
            raise TemplateError(f"cannot read {self.source!r}")
        while sign := self.take(".", "["):
            if sign == ".":
                kind, value = self.tokens[self.at]
                if kind != "name":
                    raise TemplateError(f"a name is missing in {self.source!r}")
                self.at += 1
                node = Key(node, Const(value))
            else:
                node = Key(node, self.either())
                self.need("]")
        return node


def parse(source: str) -> list:
    """The syntax tree of a template."""
    parts, at, strip = [], 0, False
    for found in _TAG.finditer(source):
        text = source[at:found.start()]
        text = text.lstrip() if strip else text
        tag = found[0]
        if tag[2:3] == "-":
            text = text.rstrip()
        strip = tag[-3:-2] == "-" and not tag.startswith("{#")
        if text:
            parts.append(("text", text))
        if found[1] is not None:
            parts.append(("tag", found[1].strip()))
        elif found[2] is not None:
            parts.append(("value", found[2].strip()))
        at = found.end()
    text = source[at:].lstrip() if strip else source[at:]
    if text:
        parts.append(("text", text))
    parts.append(("end", ""))
    tree, rest = _body(parts, 0, ())
    if rest != len(parts):
        raise TemplateError("text after the end")
    return tree


def _body(parts: list, at: int, ends: tuple[str, ...]) -> tuple[list, int]:
    out: list = []
    while True:
        kind, value = parts[at]
        at += 1
        if kind == "end":
            if ends:
                raise TemplateError(f"{ends[-1]} is missing")
            return out, at
        if kind == "text":
            if "{%" in value or "{{" in value:
                raise TemplateError("a tag is not closed")
            out.append(Output(Const(value)))
            continue
        if kind == "value":
            out.append(Output(_Expression(value).whole()))
            continue
        word, _, rest = value.partition(" ")
        if word in ends:
            return out, at - 1
        if word == "if":
            node, at = _branch(rest, parts, at)
            out.append(node)
        elif word == "for":
            found = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
            if not found:
                raise TemplateError("only the messages can be looped over")
            body, at = _body(parts, at, ("endfor",))
            out.append(Loop(found[1], body))
            at += 1
        elif word == "set":
            found = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.*)", rest, re.S)
            if not found:
                raise TemplateError("set needs a name and a value")
            out.append(Set(found[1], _Expression(found[2]).whole()))
        elif word == "generation":
            body, at = _body(parts, at, ("endgeneration",))
            out.append(Generation(body))
            at += 1
        else:
            raise TemplateError(f"unknown tag {value!r}")


def _branch(test: str, parts: list, at: int) -> tuple[If, int]:
    then, at = _body(parts, at, ("elif", "else", "endif"))
    word, _, rest = parts[at][1].partition(" ")
    other: list = []
    if word == "elif":
        node, at = _branch(rest, parts, at + 1)
        return If(_Expression(test).whole(), then, [node]), at
    if word == "else":
        other, at = _body(parts, at + 1, ("endif",))
    return If(_Expression(test).whole(), then, other), at + 1


# -- folding --------------------------------------------------------------------

def fold(node):
    """An expression without operations on constants."""
    if isinstance(node, Unary):
        node = Unary(node.name, fold(node.of))
        if isinstance(node.of, Const):
            return Const(not node.of.value if node.name == "not" else FILTERS[node.name](node.of.value))
    elif isinstance(node, Binary):
        node = Binary(node.name, fold(node.left), fold(node.right))
        if isinstance(node.left, Const) and node.name in ("and", "or"):
            return node.right if bool(node.left.value) == (node.name == "and") else node.left
        if isinstance(node.left, Const) and isinstance(node.right, Const):
            try:
                return Const(COMPARE[node.name](node.left.value, node.right.value))
            except TypeError as wrong:
                raise TemplateError(str(wrong)) from None
    elif isinstance(node, Key):
        node = Key(fold(node.of), fold(node.key))
    return node


def fold_body(body: list) -> list:
    """Statements with folded expressions; dead branches go, neighbouring texts become one."""
    out: list = []
    for node in body:
        if isinstance(node, If):
            test = fold(node.test)
            if isinstance(test, Const):
                new = fold_body(node.then if test.value else node.other)
            else:
                new = [If(test, fold_body(node.then), fold_body(node.other))]
        elif isinstance(node, Output):
            value = fold(node.value)
            new = [Output(Const(_text(value.value)) if isinstance(value, Const) else value)]
        elif isinstance(node, Set):
            new = [Set(node.name, fold(node.value))]
        elif isinstance(node, Generation):
            new = [Generation(fold_body(node.body))]
        else:
            new = [Loop(node.name, fold_body(node.body))]
        for item in new:
            last = out[-1] if out else None
            if all(isinstance(x, Output) and isinstance(x.value, Const) for x in (item, last)):
                out[-1] = Output(Const(last.value.value + item.value.value))
            elif not (isinstance(item, Output) and isinstance(item.value, Const) and not item.value.value):
                out.append(item)
    return out


# -- closures -------------------------------------------------------------------

@dataclass
class Page:
    """What has been rendered: pieces of text, their length, and the spans under generation."""

    pieces: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)

    def text(self) -> str:
        return "".join(self.pieces)


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Key):
        of, key = _value(node.of), _value(node.key)

        def look_up(scope):
            held = of(scope)
            return held.get(key(scope)) if type(held) is dict else None
        return look_up
    if isinstance(node, Unary):
        of = _value(node.of)
        if node.name == "not":
            return lambda scope: not of(scope)
        run = FILTERS[node.name]
        return lambda scope: run(of(scope))
    left, right = _value(node.left), _value(node.right)
    if node.name == "and":
        return lambda scope: left(scope) and right(scope)
    if node.name == "or":
        return lambda scope: left(scope) or right(scope)
    run2 = COMPARE[node.name]
    return lambda scope: run2(left(scope), right(scope))


def _block(body: list) -> Callable[[dict, Page], None]:
    steps = [_statement(node) for node in body]

    def run(scope: dict, page: Page) -> None:
        for step in steps:
            step(scope, page)
    return steps[0] if len(steps) == 1 else run


def _statement(node) -> Callable[[dict, Page], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            text = node.value.value
            return lambda scope, page: page.add(text)
        value = _value(node.value)
        return lambda scope, page: page.add(_text(value(scope)))
    if isinstance(node, Set):
        name, value = node.name, _value(node.value)

        def assign(scope, page):
            scope[name] = value(scope)
        return assign
    if isinstance(node, If):
        test, then, other = _value(node.test), _block(node.then), _block(node.other)
        return lambda scope, page: then(scope, page) if test(scope) else other(scope, page)
    if isinstance(node, Generation):
        body = _block(node.body)

        def generate(scope, page):
            start = page.size
            body(scope, page)
            page.spans.append((start, page.size))
        return generate
    raise TemplateError("the messages can be looped over once, at the top level")


@dataclass
class Program:
    """A compiled template: before the loop, for each message, behind the loop."""

    name: str
    head: Callable[[dict, Page], None]
    body: Callable[[dict, Page], None]
    tail: Callable[[dict, Page], None]

    def message(self, scope: dict, page: Page, message: dict, index: int, last: bool) -> None:
        inner = {**scope, self.name: message, "loop": {"index0": index, "index": index + 1, "first": not index,
                                                       "last": last}}
        self.body(inner, page)

    def render(self, messages: list[dict], **scope) -> Page:
        """A whole conversation at once."""
        page = Page()
        self.head(scope, page)
        for k, message in enumerate(messages):
            self.message(scope, page, message, k, k + 1 == len(messages))
        self.tail(scope, page)
        return page


def compile_template(source: str) -> Program:
    tree = fold_body(parse(source))
    loops = [k for k, node in enumerate(tree) if isinstance(node, Loop)]
    if len(loops) != 1:
        raise TemplateError("a template needs one loop over the messages")
    at = loops[0]
    return Program(tree[at].name, _block(tree[:at]), _block(tree[at].body), _block(tree[at + 1:]))
