"""A small sandboxed template language for conversations, compiled to Python closures (operator 11).

    {{ turn.text | guarded }}     an expression: names, strings, whole numbers, true, false, none, a.b, a[b],
                                  or, and, not, in, == != < > <= >=, + - ~ (joins texts), filters with arguments
    {% if … %} {% elif … %} {% else %} {% endif %}
    {% for turn in messages %} … {% endfor %}     with loop.index, loop.first and loop.last
    {% set name = … %}
    {% generation %} … {% endgeneration %}        what stands between is what a model learns to write
    {# a comment #}                               a dash inside a mark, as in {%-, drops white space there

A dot only looks up keys of given mappings; nothing reaches Python objects, and only the filters below can
be called. What is known beforehand, given constants included, is folded: expressions, branches, neighbouring
texts. `messages` may only be looped over, at the top of a template, so each turn can be rendered by
itself, wherever it lies.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

Scope = dict[str, Any]
Expression = Callable[[Scope], Any]


class TemplateError(ValueError):
    """The template is not valid, or asks for something that is not there."""


def guard(text: str, marks: Sequence[str]) -> str:
    """A backslash before every backslash and every start of a mark; `unguard` takes them away."""
    if not any(mark in text for mark in ("\\", *marks)):
        return text
    return re.sub("(?=" + "|".join(map(re.escape, ("\\", *marks))) + ")", r"\\", text)


def unguard(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def _text(value: Any) -> str:
    if value is None or isinstance(value, Mapping):
        raise TemplateError("only texts, numbers and truth values can be written")
    return str(value).lower() if isinstance(value, bool) else str(value)


#: Filters get the value, their arguments and the marks of the template.
FILTERS: dict[str, Callable[..., Any]] = {
    "guarded": lambda value, *more, marks: guard(_text(value), (*marks, *more)),
    "trim": lambda value, marks: _text(value).strip(),
    "upper": lambda value, marks: _text(value).upper(),
    "lower": lambda value, marks: _text(value).lower(),
    "length": lambda value, marks: len(value),
    "replace": lambda value, old, new, marks: _text(value).replace(old, new),
    "default": lambda value, other, marks: other if value is None else value,
}

OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "~": lambda a, b: _text(a) + _text(b),
}


# Syntax tree.


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Item:
    base: Any
    key: Any


@dataclass
class Apply:
    """An operator or filter; `lazy` ones (and, or) look at their second value only if they need it."""

    name: str
    values: list
    kind: str = "operator"


@dataclass
class Out:
    value: Any


@dataclass
class If:
    branches: list[tuple[Any, list]]


@dataclass
class For:
    name: str
    values: Any
    body: list


@dataclass
class Set:
    name: str
    value: Any


@dataclass
class Generation:
    body: list


_TOKEN = re.compile(
    r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<sign>==|!=|<=|>=|[-<>+~|.,()\[\]=]))",
    re.DOTALL,
)
_MARK = re.compile(
    r"(?P<lead>\s*)(?:\{(?P<kind>[{%])(?P<left>-?)(?P<inner>(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^'\"])*?)"
    r"(?P<right>-?)[%}]\}|\{#(?P<left2>-?).*?(?P<right2>-?)#\})",
    re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "-", "~"))


class _Expressions:
    """Recursive descent over the tokens of one expression or statement."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        place, source = 0, source.strip()
        while place < len(source):
            found = _TOKEN.match(source, place)
            if found is None:
                raise TemplateError(f"cannot read {source[place:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            place = found.end()
        self.next = 0

    def peek(self) -> str | None:
        """The next sign or name; None at the end and before literals."""
        if self.next >= len(self.tokens) or self.tokens[self.next][0] in ("string", "number"):
            return None
        return self.tokens[self.next][1]

    def take(self, wanted: str | None = None, kind: str | None = None) -> str:
        if self.next >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        found, value = self.tokens[self.next]
        if (wanted is not None and value != wanted) or (kind is not None and found != kind):
            raise TemplateError(f"{value!r} instead of {wanted or kind}")
        self.next += 1
        return value

    def done(self) -> None:
        if self.next < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.next][1]!r} is left over")

    def expression(self, level: int = 0) -> Any:
        if level == len(_LEVELS):
            return self.value()
        if _LEVELS[level] == ("not",):
            if self.peek() == "not":
                self.take()
                return Apply("not", [self.expression(level)])
            return self.expression(level + 1)
        left = self.expression(level + 1)
        while self.peek() in _LEVELS[level]:
            left = Apply(self.take(), [left, self.expression(level + 1)])
        return left

    def value(self) -> Any:
        kind, token = self.tokens[self.next] if self.next < len(self.tokens) else ("end", "")
        self.take()
        if kind == "string":
            one = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.DOTALL))
        elif kind == "number":
            one = Const(int(token))
        elif kind == "name":
            words = {"true": True, "false": False, "none": None}
            one = Const(words[token]) if token in words else Name(token)
        elif token == "(":
            one = self.expression()
            self.take(")")
        elif token == "-":
            return Apply("-", [Const(0), self.value()])
        else:
            raise TemplateError(f"{token!r} is no value")
        while self.peek() in (".", "[", "|"):
            sign = self.take()
            if sign == ".":
                one = Item(one, Const(self.take(kind="name")))
            elif sign == "[":
                one = Item(one, self.expression())
                self.take("]")
            else:
                name, more = self.take(kind="name"), []
                if name not in FILTERS:
                    raise TemplateError(f"there is no filter {name}")
                if self.peek() == "(":
                    self.take()
                    while self.peek() != ")":
                        more.append(self.expression())
                        if self.peek() != ")":
                            self.take(",")
                    self.take(")")
                one = Apply(name, [one, *more], "filter")
        return one


def parse(source: str) -> list:
    """The syntax tree of a template."""
    root: list = []
    #: Open statements with the lists that their next nodes go to.
    stack: list[tuple[str, Any, list]] = [("", None, root)]
    place, strip = 0, False

    def text(piece: str) -> None:
        if (mark := re.search(r"\{[{%#]", piece)) is not None:
            raise TemplateError(f"{mark[0]} is not closed")
        if piece:
            stack[-1][2].append(Const(piece))

    while (found := _MARK.search(source, place)) is not None:
        piece = source[place : found.start()] + found["lead"]
        piece = piece.lstrip() if strip else piece
        text(piece.rstrip() if found["left"] or found["left2"] else piece)
        place, strip = found.end(), bool(found["right"] or found["right2"])
        if found["kind"] is None:
            continue
        if source[place - 2] != {"{": "}", "%": "%"}[found["kind"]]:
            raise TemplateError(f"{found[0].strip()!r} is not closed")
        tokens = _Expressions(found["inner"])
        if found["kind"] == "{":
            stack[-1][2].append(Out(tokens.expression()))
        else:
            _statement(tokens, stack)
        tokens.done()
    text(source[place:].lstrip() if strip else source[place:])
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return root


def _statement(tokens: _Expressions, stack: list[tuple[str, Any, list]]) -> None:
    word = tokens.take(kind="name")
    opened, node, into = stack[-1]
    if word == "if":
        branches = If([(tokens.expression(), [])])
        into.append(branches)
        stack.append(("if", branches, branches.branches[-1][1]))
    elif word in ("elif", "else") and opened == "if":
        node.branches.append((tokens.expression() if word == "elif" else Const(True), []))
        stack[-1] = ("if" if word == "elif" else "else", node, node.branches[-1][1])
    elif word == "for":
        name = tokens.take(kind="name")
        tokens.take("in")
        loop = For(name, tokens.expression(), [])
        into.append(loop)
        stack.append(("for", loop, loop.body))
    elif word == "set":
        name = tokens.take(kind="name")
        tokens.take("=")
        into.append(Set(name, tokens.expression()))
    elif word == "generation":
        if any(one[0] == "generation" for one in stack):
            raise TemplateError("a generation inside another one")
        block = Generation([])
        into.append(block)
        stack.append(("generation", block, block.body))
    elif word.startswith("end") and (opened == word[3:] or (opened == "else" and word == "endif")):
        stack.pop()
    else:
        raise TemplateError(f"{word} has no place here")


# Folding.


def _fold_value(node: Any, known: Scope, marks: Sequence[str]) -> Any:
    if isinstance(node, Name):
        return Const(known[node.name]) if node.name in known else node
    if isinstance(node, Item):
        folded = Item(_fold_value(node.base, known, marks), _fold_value(node.key, known, marks))
        fixed = isinstance(folded.base, Const) and isinstance(folded.key, Const)
    elif isinstance(node, Apply):
        values = [_fold_value(one, known, marks) for one in node.values]
        folded = Apply(node.name, values, node.kind)
        if node.name in ("and", "or") and isinstance(values[0], Const):
            return values[1] if bool(values[0].value) == (node.name == "and") else values[0]
        fixed = all(isinstance(one, Const) for one in values)
    else:
        return node
    return Const(_compile_value(folded, marks)({})) if fixed else folded


def fold(nodes: list, known: Scope, marks: Sequence[str] = ()) -> list:
    """The same output with everything worked out that does not depend on a conversation.

    Names that the template sets or loops over are never taken for `known` ones.
    """
    value = lambda node: _fold_value(node, known, marks)
    folded: list = []
    for node in nodes:
        if isinstance(node, Out):
            one = value(node.value)
            node = Const(_text(one.value)) if isinstance(one, Const) else Out(one)
        elif isinstance(node, If):
            branches: list[tuple[Any, list]] = []
            for test, body in node.branches:
                test = value(test)
                if not isinstance(test, Const) or test.value:
                    branches.append((test, fold(body, known, marks)))
                if isinstance(test, Const) and test.value:
                    break
            if not branches or isinstance(branches[0][0], Const):
                for one in branches[0][1] if branches else []:
                    _append(folded, one)
                continue
            node = If(branches)
        elif isinstance(node, For):
            node = For(node.name, value(node.values), fold(node.body, known, marks))
        elif isinstance(node, Set):
            node = Set(node.name, value(node.value))
        elif isinstance(node, Generation):
            node = Generation(fold(node.body, known, marks))
        _append(folded, node)
    return folded


def _append(nodes: list, node: Any) -> None:
    if isinstance(node, Const) and nodes and isinstance(nodes[-1], Const):
        nodes[-1] = Const(nodes[-1].value + node.value)
    elif not isinstance(node, Const) or node.value:
        nodes.append(node)


def _assigned(nodes: list) -> set[str]:
    names: set[str] = set()
    for node in nodes:
        if isinstance(node, (Set, For)):
            names.add(node.name)
        if isinstance(node, (For, Generation)):
            names |= _assigned(node.body)
        if isinstance(node, If):
            names = names.union(*(_assigned(body) for _, body in node.branches))
    return names


# Closures.


@dataclass
class Writer:
    """Text as it is written, and where what a model learns starts and stops in it."""

    pieces: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


Step = Callable[[Scope, Writer], None]


def _look_up(base: Any, key: Any) -> Any:
    if isinstance(base, Mapping) and isinstance(key, str):
        return base.get(key)
    if isinstance(base, (list, tuple)) and isinstance(key, int) and -len(base) <= key < len(base):
        return base[key]
    raise TemplateError(f"nothing to be found under {key!r}")


def _compile_value(node: Any, marks: Sequence[str]) -> Expression:
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        name = node.name

        def named(scope: Scope) -> Any:
            if name not in scope:
                raise TemplateError(f"{name} is not given")
            return scope[name]

        return named
    if isinstance(node, Item):
        base, key = _compile_value(node.base, marks), _compile_value(node.key, marks)
        return lambda scope: _look_up(base(scope), key(scope))
    values = [_compile_value(one, marks) for one in node.values]
    if node.kind == "filter":
        call = FILTERS[node.name]
        return lambda scope: call(*(value(scope) for value in values), marks=marks)
    if node.name == "not":
        return lambda scope: not values[0](scope)
    left, right = values
    if node.name == "and":
        return lambda scope: left(scope) and right(scope)
    if node.name == "or":
        return lambda scope: left(scope) or right(scope)
    operator = OPERATORS[node.name]
    return lambda scope: operator(left(scope), right(scope))


def _compile(nodes: list, marks: Sequence[str]) -> Step:
    steps = [_compile_node(node, marks) for node in nodes]

    def run(scope: Scope, out: Writer) -> None:
        for step in steps:
            step(scope, out)

    return run


def _compile_node(node: Any, marks: Sequence[str]) -> Step:
    if isinstance(node, Const):
        return lambda scope, out, text=node.value: out.write(text)
    if isinstance(node, Out):
        value = _compile_value(node.value, marks)
        return lambda scope, out: out.write(_text(value(scope)))
    if isinstance(node, Set):
        value = _compile_value(node.value, marks)
        return lambda scope, out, name=node.name: scope.__setitem__(name, value(scope))
    if isinstance(node, Generation):
        body = _compile(node.body, marks)

        def generation(scope: Scope, out: Writer) -> None:
            start = out.size
            body(scope, out)
            if out.size > start:
                out.spans.append((start, out.size))

        return generation
    if isinstance(node, If):
        branches = [(_compile_value(test, marks), _compile(body, marks)) for test, body in node.branches]

        def choose(scope: Scope, out: Writer) -> None:
            for test, body in branches:
                if test(scope):
                    return body(scope, out)

        return choose
    values, body = _compile_value(node.values, marks), _compile(node.body, marks)

    def loop(scope: Scope, out: Writer) -> None:
        found = values(scope)
        if not isinstance(found, (list, tuple)):
            raise TemplateError("only lists are looped over")
        for place, one in enumerate(found):
            body(_inside(scope, node.name, one, place, place == len(found) - 1), out)

    return loop


def _inside(scope: Scope, name: str, value: Any, place: int, last: bool) -> Scope:
    return {**scope, name: value, "loop": {"index": place + 1, "first": place == 0, "last": last}}


class Template:
    """A compiled template: what stands before the turns, one turn, and what stands behind them."""

    def __init__(self, source: str, marks: Sequence[str] = (), **constants: Any) -> None:
        tree = parse(source)
        known = {name: value for name, value in constants.items() if name not in _assigned(tree)}
        self.constants, self.tree = constants, fold(tree, known, tuple(marks))
        turns = [
            place
            for place, node in enumerate(self.tree)
            if isinstance(node, For) and node.values == Name("messages")
        ]
        if len(turns) != 1 or _reads_messages(
            [*self.tree[: turns[0]], *self.tree[turns[0] + 1 :], *self.tree[turns[0]].body]
        ):
            raise TemplateError("a template has one loop over messages, at its top, and no other use of them")
        place = turns[0]
        self.name = self.tree[place].name
        marks = tuple(marks)
        self._head, self._body, self._tail = (
            _compile(part, marks)
            for part in (self.tree[:place], self.tree[place].body, self.tree[place + 1 :])
        )

    def turn(self, turn: Mapping[str, Any], place: int, last: bool) -> Writer:
        """One turn, number `place` from 0, with the head before the first and the tail behind the last."""
        out, scope = Writer(), dict(self.constants)
        # The head may set names that later parts read.
        self._head(scope, out if place == 0 else Writer())
        self._body(_inside(scope, self.name, turn, place, last), out)
        if last:
            self._tail(scope, out)
        return out

    def render(self, messages: Sequence[Mapping[str, Any]]) -> Writer:
        """A whole conversation."""
        out = Writer()
        for place, one in enumerate(messages):
            part = self.turn(one, place, place == len(messages) - 1)
            out.spans += [(out.size + a, out.size + b) for a, b in part.spans]
            out.write("".join(part.pieces))
        return out


def _reads_messages(node: Any) -> bool:
    if isinstance(node, Name):
        return node.name == "messages"
    if isinstance(node, (list, tuple)):
        return any(map(_reads_messages, node))
    return hasattr(node, "__dataclass_fields__") and any(map(_reads_messages, vars(node).values()))
