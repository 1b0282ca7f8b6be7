"""A small sandboxed template language: syntax tree, folded constants, Python closures.

Text stands as it is. ``{{ e }}`` puts a value in; ``{% for x in e %}..{% endfor %}``,
``{% if e %}..{% elif e %}..{% else %}..{% endif %}``, ``{% set x = e %}`` and
``{% generation %}..{% endgeneration %}`` (what a model would have written) are the statements,
``{# #}`` a comment; a ``-`` beside a bracket takes the white space on that side away.
Expressions have strings, whole numbers, ``true``, ``false``, ``none``, names, ``a.key``,
``a['key']``, ``a | filter``, ``~`` (join as text), ``==``, ``!=``, ``in``, ``not``, ``and``,
``or`` and parentheses. In a loop ``loop`` has ``index``, ``index0``, ``first`` and ``last``.

Nothing of Python can be reached: a key is looked up in mappings alone, filters come from
``FILTERS``, and there are no calls, no attributes and no loops but over what was passed in. A
missing name or key is ``none``, which prints as nothing.

A compiled template is a generator of strings and of the marks ``OPEN`` and ``CLOSE`` around
generated text. It reads what it loops over one element at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

OPEN, CLOSE = object(), object()

CONTROL = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """``text`` without ``<|``, the start of every control string; ``unescape`` undoes it."""
    return CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text) if "\\" in text else text


def shown(value: Any) -> str:
    return "" if value is None else str(value)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda value: escape(shown(value)),
    "trim": lambda value: shown(value).strip(),
    "upper": lambda value: shown(value).upper(),
    "lower": lambda value: shown(value).lower(),
    "length": lambda value: len(value) if isinstance(value, (str, list, tuple, dict)) else 0,
}


class TemplateError(ValueError):
    """The template is not of the language."""


# The syntax tree -------------------------------------------------------------------


@dataclass(frozen=True)
class Constant:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: Any


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str


@dataclass(frozen=True)
class Operation:
    sign: str
    parts: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Put:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body) pairs; the last one's condition is true for "else"


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# From text to tree -----------------------------------------------------------------

BRACKETS = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.DOTALL)
TOKEN = re.compile(
    r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)"""
    r"""|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[.|~()\[\]=]))"""
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = {"true": True, "false": False, "none": None}
RESERVED = {*WORDS, "and", "or", "not", "in", "loop"}


def _tokens(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        match = TOKEN.match(text, at)
        if match is None:
            raise TemplateError(f"can't read {text[at:at + 20]!r}")
        found.append((match.lastgroup, match.group(match.lastgroup)))
        at = match.end()
    return found


class _Expression:
    """Reads one expression, each level binding tighter than the one before."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def whole(self) -> Any:
        value = self._any()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is one too many")
        return value

    def _is(self, *texts: str) -> str | None:
        if self.at < len(self.tokens):
            kind, text = self.tokens[self.at]
            if kind != "string" and text in texts:
                self.at += 1
                return text
        return None

    def _need(self, text: str) -> None:
        if not self._is(text):
            raise TemplateError(f"{text!r} is missing")

    def _any(self) -> Any:
        parts = [self._all()]
        while self._is("or"):
            parts.append(self._all())
        return parts[0] if len(parts) == 1 else Operation("or", tuple(parts))

    def _all(self) -> Any:
        parts = [self._not()]
        while self._is("and"):
            parts.append(self._not())
        return parts[0] if len(parts) == 1 else Operation("and", tuple(parts))

    def _not(self) -> Any:
        return Operation("not", (self._not(),)) if self._is("not") else self._compared()

    def _compared(self) -> Any:
        left = self._joined()
        sign = self._is("==", "!=", "in")
        return Operation(sign, (left, self._joined())) if sign else left

    def _joined(self) -> Any:
        parts = [self._filtered()]
        while self._is("~"):
            parts.append(self._filtered())
        return parts[0] if len(parts) == 1 else Operation("~", tuple(parts))

    def _filtered(self) -> Any:
        value = self._single()
        while True:
            if self._is("."):
                value = Key(value, Constant(self._name()))
            elif self._is("["):
                value = Key(value, self._any())
                self._need("]")
            elif self._is("|"):
                name = self._name()
                if name not in FILTERS:
                    raise TemplateError(f"there is no filter {name!r}")
                value = Filter(value, name)
            else:
                return value

    def _name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def _single(self) -> Any:
        if self._is("("):
            value = self._any()
            self._need(")")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Constant(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1],
                                   flags=re.DOTALL))
        if kind == "number":
            return Constant(int(text))
        if kind == "name" and text in WORDS:
            return Constant(WORDS[text])
        if kind == "name" and (text == "loop" or text not in RESERVED):
            return Name(text)
        raise TemplateError(f"{text!r} is out of place")


def _pieces(source: str) -> list[tuple[str, str]]:
    """("text" | "put" | "tag", content); comments and trimmed white space are gone."""
    found, at, trim = [], 0, False
    for match in BRACKETS.finditer(source):
        kind = ("put", "tag", "note")[(match.lastindex - 1) // 3]
        before, inside, after = match.groups()[(match.lastindex - 1) // 3 * 3:][:3]
        text = source[at:match.start()]
        text = text.lstrip() if trim else text
        found.append(("text", text.rstrip() if before else text))
        if kind != "note":
            found.append((kind, inside))
        at, trim = match.end(), bool(after)
    found.append(("text", source[at:].lstrip() if trim else source[at:]))
    for kind, text in found:
        if kind == "text" and re.search(r"\{[{%#]", text):
            raise TemplateError("a bracket is not closed")
    return [(kind, text) for kind, text in found if kind != "text" or text]


def _name_of(tokens: list[tuple[str, str]], place: int) -> str:
    if len(tokens) <= place or tokens[place][0] != "name" or tokens[place][1] in RESERVED:
        raise TemplateError("a name is missing")
    return tokens[place][1]


def parsed(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces = _pieces(source)
    at = 0

    def block(*ends: str) -> tuple[tuple, str, list]:
        nonlocal at
        nodes = []
        while at < len(pieces):
            kind, text = pieces[at]
            at += 1
            if kind == "text":
                nodes.append(Text(text))
                continue
            tokens = _tokens(text)
            if kind == "put":
                nodes.append(Put(_Expression(tokens).whole()))
                continue
            word, rest = (tokens[0][1], tokens[1:]) if tokens else ("", [])
            if word in ends:
                return tuple(nodes), word, rest
            if word == "for":
                if len(rest) < 3 or rest[1] != ("name", "in"):
                    raise TemplateError("for x in ... is needed")
                body, _, _ = block("endfor")
                nodes.append(For(_name_of(rest, 0), _Expression(rest[2:]).whole(), body))
            elif word == "if":
                branches, condition, last = [], _Expression(rest).whole(), ""
                while last != "endif":
                    more = () if last == "else" else ("elif", "else")
                    body, last, rest = block("endif", *more)
                    branches.append((condition, body))
                    condition = _Expression(rest).whole() if last == "elif" else Constant(True)
                nodes.append(If(tuple(branches)))
            elif word == "set":
                if len(rest) < 3 or rest[1] != ("sign", "="):
                    raise TemplateError("set x = ... is needed")
                nodes.append(Set(_name_of(rest, 0), _Expression(rest[2:]).whole()))
            elif word == "generation":
                nodes.append(Generation(block("endgeneration")[0]))
            else:
                raise TemplateError(f"{word!r} is no statement here")
        if ends:
            raise TemplateError(f"{ends[0]!r} is missing")
        return tuple(nodes), "", []

    return block()[0]


# Constants -------------------------------------------------------------------------


def _operate(sign: str, left: Any, right: Any) -> Any:
    if sign == "==":
        return left == right
    if sign == "!=":
        return left != right
    if isinstance(right, str):
        return isinstance(left, str) and left in right
    return isinstance(right, (list, tuple, Mapping)) and left in right


def _looked_up(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and key < len(of):
        return of[key]
    return None


def folded_value(node: Any) -> Any:
    """The expression with everything worked out that needs no input."""
    if isinstance(node, Key):
        of, key = folded_value(node.of), folded_value(node.key)
        both = isinstance(of, Constant) and isinstance(key, Constant)
        return Constant(_looked_up(of.value, key.value)) if both else Key(of, key)
    if isinstance(node, Filter):
        of = folded_value(node.of)
        if isinstance(of, Constant):
            return Constant(FILTERS[node.name](of.value))
        return Filter(of, node.name)
    if not isinstance(node, Operation):
        return node
    parts = [folded_value(part) for part in node.parts]
    known = all(isinstance(part, Constant) for part in parts)
    if node.sign in ("and", "or"):
        stop = node.sign == "or"
        kept = []
        for i, part in enumerate(parts):
            if isinstance(part, Constant) and i + 1 < len(parts) and bool(part.value) != stop:
                continue  # neither decides nor is the last, whose value it would be
            kept.append(part)
            if isinstance(part, Constant) and bool(part.value) == stop:
                break
        return kept[0] if len(kept) == 1 else Operation(node.sign, tuple(kept))
    if node.sign == "not":
        return Constant(not parts[0].value) if known else Operation("not", tuple(parts))
    if node.sign == "~":
        joined: list[Any] = []
        for part in parts:
            if isinstance(part, Constant) and joined and isinstance(joined[-1], Constant):
                joined[-1] = Constant(shown(joined[-1].value) + shown(part.value))
            else:
                joined.append(part)
        if len(joined) == 1 and isinstance(joined[0], Constant):
            return Constant(shown(joined[0].value))
        return Operation("~", tuple(joined))
    if known:
        return Constant(_operate(node.sign, parts[0].value, parts[1].value))
    return Operation(node.sign, tuple(parts))


def folded(nodes: tuple) -> tuple:
    """The tree with constant expressions worked out, branches that can't be reached left
    out, and neighbouring texts joined."""
    out: list[Any] = []

    def add(node: Any) -> None:
        if isinstance(node, Text):
            if not node.text:
                return
            if out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + node.text)
                return
        out.append(node)

    for node in nodes:
        if isinstance(node, Put):
            value = folded_value(node.value)
            parts = value.parts if isinstance(value, Operation) and value.sign == "~" else [value]
            for part in parts:
                add(Text(shown(part.value)) if isinstance(part, Constant) else Put(part))
        elif isinstance(node, For):
            over, body = folded_value(node.over), folded(node.body)
            if body and not (isinstance(over, Constant) and not over.value):
                add(For(node.name, over, body))
        elif isinstance(node, If):
            kept = []
            for condition, body in node.branches:
                condition = folded_value(condition)
                if isinstance(condition, Constant) and not condition.value:
                    continue
                kept.append((condition, folded(body)))
                if isinstance(condition, Constant):
                    break
            if kept and isinstance(kept[0][0], Constant):
                for inner in kept[0][1]:
                    add(inner)
            elif any(body for _, body in kept):
                add(If(tuple(kept)))
        elif isinstance(node, Set):
            add(Set(node.name, folded_value(node.value)))
        elif isinstance(node, Generation):
            body = folded(node.body)
            if body:
                add(Generation(body))
        else:
            add(node)
    return tuple(out)


# Closures --------------------------------------------------------------------------

Scope = dict[str, Any]


def _value_of(node: Any) -> Callable[[Scope], Any]:
    if isinstance(node, Constant):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Key):
        of, key = _value_of(node.of), _value_of(node.key)
        return lambda scope: _looked_up(of(scope), key(scope))
    if isinstance(node, Filter):
        of, use = _value_of(node.of), FILTERS[node.name]
        return lambda scope: use(of(scope))
    parts = [_value_of(part) for part in node.parts]
    if node.sign == "not":
        return lambda scope: not parts[0](scope)
    if node.sign == "~":
        return lambda scope: "".join([shown(part(scope)) for part in parts])
    if node.sign in ("and", "or"):
        stop = node.sign == "or"

        def decide(scope: Scope) -> Any:
            value = None
            for part in parts:
                value = part(scope)
                if bool(value) == stop:
                    break
            return value

        return decide
    sign, (left, right) = node.sign, parts
    return lambda scope: _operate(sign, left(scope), right(scope))


def _closure(node: Any) -> Callable[[Scope], Iterator[Any]]:
    if isinstance(node, Text):
        text = node.text

        def write(scope: Scope) -> Iterator[Any]:
            yield text

    elif isinstance(node, Put):
        value = _value_of(node.value)

        def write(scope: Scope) -> Iterator[Any]:
            yield shown(value(scope))

    elif isinstance(node, Set):
        name, value = node.name, _value_of(node.value)

        def write(scope: Scope) -> Iterator[Any]:
            scope[name] = value(scope)
            return iter(())

    elif isinstance(node, Generation):
        body = _all_of(node.body)

        def write(scope: Scope) -> Iterator[Any]:
            yield OPEN
            yield from body(scope)
            yield CLOSE

    elif isinstance(node, If):
        branches = [(_value_of(condition), _all_of(body)) for condition, body in node.branches]

        def write(scope: Scope) -> Iterator[Any]:
            for condition, body in branches:
                if condition(scope):
                    return body(scope)
            return iter(())

    else:
        name, over, body = node.name, _value_of(node.over), _all_of(node.body)

        def write(scope: Scope) -> Iterator[Any]:
            looped = over(scope)
            if looped is None or isinstance(looped, (str, bool, int, Mapping)):
                return
            elements, number = iter(looped), 0
            end = object()
            element = next(elements, end)
            while element is not end:
                following = next(elements, end)
                yield from body(scope | {name: element, "loop": {
                    "index": number + 1, "index0": number, "first": number == 0,
                    "last": following is end}})
                element, number = following, number + 1

    return write


def _all_of(nodes: tuple) -> Callable[[Scope], Iterator[Any]]:
    writers = [_closure(node) for node in nodes]
    if len(writers) == 1:
        return writers[0]

    def write(scope: Scope) -> Iterator[Any]:
        for writer in writers:
            yield from writer(scope)

    return write


def compiled(source: str) -> Callable[..., Iterator[Any]]:
    """A function of named inputs that yields the strings and marks of the rendered template."""
    write = _all_of(folded(parsed(source)))
    return lambda **inputs: write(inputs)
