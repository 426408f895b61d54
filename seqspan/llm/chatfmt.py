"""Chat formatting: a template compiler and a reader of its output.

A sandboxed template language is parsed into a syntax tree, constants are folded, and what is left becomes Python closures
that render a conversation piece by piece, each piece with a flag that says whether it lies in a ``generation`` block.

    {{ expression }}                                             output
    {% for m in messages %} ... {% endfor %}                     loop.index, loop.first
    {% if a == "x" and not b %} ... {% elif c %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}                     the loss mask

Expressions have names, attributes of messages and of ``loop``, string and integer literals, ``==  !=  ~  and  or  not``,
parentheses, and filters: ``escape``, ``line``, ``upper``, ``lower``, ``trim``.  Nothing else can be reached.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CHAT_TEMPLATE = (
    '{% for m in messages %}{{ "<|" ~ "im_start" ~ "|>" }}{{ m.role | line }}\n'
    '{% if m.role == "assistant" %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}'
    "<|im_end|>\n{% endfor %}"
)


class TemplateError(ValueError):
    """The template isn't in the language."""


def escape(text: str) -> str:
    """Breaks up whatever looks like the start of a control string: ``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|``, and so on."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def line(text: str) -> str:
    """:func:`escape` for text that must stay on one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "line": line, "upper": str.upper, "lower": str.lower, "trim": str.strip}

# the syntax tree


@dataclass
class Constant:
    value: object


@dataclass
class Name:
    path: tuple[str, ...]


@dataclass
class Operation:
    name: str
    parts: list


@dataclass
class Output:
    value: object


@dataclass
class Loop:
    name: str
    over: object
    body: list


@dataclass
class Choice:
    cases: list = field(default_factory=list)  # (condition, body); the last condition may be Constant(True)


@dataclass
class Generation:
    body: list


_TOKEN = re.compile(r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<sign>==|!=|[~|.()]))""")
_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent: or, and, not, comparison, ``~``, filters, terms."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError(f"{self.source!r} ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")
        return out

    def chain(self, below, *signs: str):
        out = below()
        while self.peek(*signs):
            out = Operation(self.take()[1], [out, below()])
        return out

    def either(self):
        return self.chain(self.both, "or")

    def both(self):
        return self.chain(self.negated, "and")

    def negated(self):
        if self.peek("not"):
            self.take()
            return Operation("not", [self.negated()])
        return self.chain(self.joined, "==", "!=")

    def joined(self):
        return self.chain(self.filtered, "~")

    def filtered(self):
        out = self.term()
        while self.peek("|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Operation("|" + name, [out])
        return out

    def term(self):
        kind, value = self.take()
        if kind == "string":
            return Constant(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1]))
        if kind == "number":
            return Constant(int(value))
        if kind == "sign" and value == "(":
            out = self.either()
            if self.take()[1] != ")":
                raise TemplateError(f"a parenthesis stays open in {self.source!r}")
            return out
        if kind == "name" and value in ("true", "false"):
            return Constant(value == "true")
        if kind == "name" and value not in ("and", "or", "not"):
            path = [value]
            while self.peek("."):
                self.take()
                kind, value = self.take()
                if kind != "name":
                    raise TemplateError(f"no attribute {value!r}")
                path.append(value)
            return Name(tuple(path))
        raise TemplateError(f"unexpected {value!r} in {self.source!r}")


def parse(source: str) -> list:
    """The syntax tree of a template."""
    root: list = []
    stack: list[tuple[str, list, object]] = [("", root, None)]
    at = 0

    def close(kind: str) -> None:
        if stack[-1][0] != kind:
            raise TemplateError(f"end of {kind} without its start")
        stack.pop()

    for m in _PART.finditer(source):
        body = stack[-1][1]
        if m.start() > at:
            body.append(Output(Constant(source[at : m.start()])))
        at = m.end()
        if m[1] is not None:
            body.append(Output(_Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            of = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip())
            if not of or of[1] == "loop":
                raise TemplateError(f"not a loop: {rest!r}")
            node = Loop(of[1], _Expression(of[2]).whole(), [])
            body.append(node)
            stack.append(("for", node.body, node))
        elif word == "if":
            node = Choice([(_Expression(rest).whole(), [])])
            body.append(node)
            stack.append(("if", node.cases[0][1], node))
        elif word in ("elif", "else"):
            node = stack[-1][2]
            close("if")
            node.cases.append((_Expression(rest).whole() if word == "elif" else Constant(True), []))
            stack.append(("if", node.cases[-1][1], node))
        elif word == "generation":
            if any(x[0] == "generation" for x in stack):
                raise TemplateError("generation within generation")
            node = Generation([])
            body.append(node)
            stack.append(("generation", node.body, node))
        elif word in ("endfor", "endif", "endgeneration"):
            close(word[3:])
        else:
            raise TemplateError(f"no statement {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't ended")
    if at < len(source):
        root.append(Output(Constant(source[at:])))
    return root


def _apply(name: str, values: list):
    if name[0] == "|":
        return FILTERS[name[1:]](_text(values[0]))
    if name == "~":
        return _text(values[0]) + _text(values[1])
    if name == "not":
        return not values[0]
    return (values[0] == values[1]) == (name == "==")


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def fold(node):
    """The same tree with constant operations done, decided conditions resolved and neighbouring constant output joined."""
    if isinstance(node, Operation):
        parts = [fold(p) for p in node.parts]
        if node.name in ("and", "or"):
            first = parts[0]
            if isinstance(first, Constant):
                return parts[1] if bool(first.value) == (node.name == "and") else first
        elif all(isinstance(p, Constant) for p in parts):
            return Constant(_apply(node.name, [p.value for p in parts]))
        return Operation(node.name, parts)
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, Loop):
        return Loop(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Choice):
        cases = []
        for condition, body in node.cases:
            condition = fold(condition)
            if isinstance(condition, Constant) and not condition.value:
                continue
            cases.append((condition, fold(body)))
            if isinstance(condition, Constant):
                break
        return Choice(cases)
    if isinstance(node, list):
        out: list = []
        for x in map(fold, node):
            inner = x.cases[0][1] if isinstance(x, Choice) and x.cases and isinstance(x.cases[0][0], Constant) else [] if isinstance(x, Choice) and not x.cases else [x]
            for y in inner:
                if isinstance(y, Output) and isinstance(y.value, Constant) and out and isinstance(out[-1], Output) and isinstance(out[-1].value, Constant):
                    out[-1] = Output(Constant(_text(out[-1].value.value) + _text(y.value.value)))
                else:
                    out.append(y)
        return out
    return node


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Constant):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        path = node.path

        def look_up(scope: dict) -> object:
            value: object = scope
            for part in path:
                if not isinstance(value, dict) or part not in value:
                    return None
                value = value[part]
            return value

        return look_up
    parts, name = [_value(p) for p in node.parts], node.name
    if name == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if name == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    return lambda scope: _apply(name, [p(scope) for p in parts])


_Pieces = Iterator[tuple[str, int]]


def _render(node, masked: bool) -> Callable[[dict], _Pieces]:
    """A generator of (text, mask): 0 outside generation, 1 inside, 2 where a generation block ends."""
    if isinstance(node, list):
        parts = [_render(x, masked) for x in node]

        def all_(scope: dict) -> _Pieces:
            for part in parts:
                yield from part(scope)

        return all_
    if isinstance(node, Output):
        value, mask = _value(node.value), int(masked)

        def output(scope: dict) -> _Pieces:
            yield _text(value(scope)), mask

        return output
    if isinstance(node, Generation):
        body = _render(node.body, True)

        def generation(scope: dict) -> _Pieces:
            yield from body(scope)
            yield "", 2

        return generation
    if isinstance(node, Choice):
        cases = [(_value(c), _render(b, masked)) for c, b in node.cases]

        def choice(scope: dict) -> _Pieces:
            for condition, body in cases:
                if condition(scope):
                    yield from body(scope)
                    return

        return choice
    over, body, name = _value(node.over), _render(node.body, masked), node.name

    def loop(scope: dict) -> _Pieces:
        for i, item in enumerate(over(scope) or ()):
            yield from body(scope | {name: item, "loop": {"index": i + 1, "first": i == 0}})

    return loop


def compile_template(source: str) -> Callable[[Iterable[dict]], _Pieces]:
    """A function from messages (dicts with role and text, read one at a time) to the pieces of the formatted text."""
    render = _render(fold(parse(source)), False)
    return lambda messages: render({"messages": messages})


def format_chat(messages: Iterable[dict], template: str = CHAT_TEMPLATE) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans of it under the loss mask)."""
    out, spans, at, begin = [], [], 0, None
    for text, mask in compile_template(template)(messages):
        if mask == 1 and begin is None:
            begin = at
        if mask == 2:
            spans.append((at if begin is None else begin, at))
            begin = None
        out.append(text)
        at += len(text)
    return "".join(out), spans


class ChatReader:
    """Reads a formatted conversation back, piece by piece; it holds one turn at a time."""

    def __init__(self) -> None:
        self.rest, self.turns, self.loss_chars, self.chars = "", 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.own: list[str] = []

    def feed(self, text: str, mask: int) -> None:
        self.chars += len(text)
        self.rest += text
        if mask == 1:
            self.own.append(text)
        elif mask == 2:
            learned = unescape("".join(self.own))
            self.own = []
            self.loss_chars += len(learned)
            self.loss_hash.update(learned.encode())
        if mask:
            return
        while (end := self.rest.find(END + "\n")) >= 0:
            head, _, body = self.rest[:end].partition("\n")
            if not head.startswith(START):
                raise ValueError(f"no turn starts at {head[:40]!r}")
            self.turns += 1
            self.turn_hash.update(f"{unline(head[len(START) :])}\n{unescape(body)}\n".encode())
            self.rest = self.rest[end + len(END) + 1 :]

    def result(self) -> tuple[int, str, int, str, int]:
        if self.rest:
            raise ValueError(f"not a whole turn: {self.rest[:40]!r}")
        return self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conv_id, its messages as they come in) of sorted rows."""
    from itertools import groupby

    def rows() -> Iterator[tuple[object, dict]]:
        for b in batches:
            for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                yield conv, {"role": role or "", "text": text or ""}

    for conv, own in groupby(rows(), key=lambda r: r[0]):
        yield conv, (message for _, message in own)


def _in_order(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")


def formatted(turns: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss_spans (pairs of begin and end) for each conversation of ``turns`` (conv_id, turn, role, text).

    Turns, nulls and repeated rows count as in :func:`digests`, and other columns are ignored.  A conversation becomes one
    text, so a task holds one at a time, however long.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, messages in _conversations(batches):
            text, spans = format_chat(messages, template)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([text], pa.string()), pa.array([[list(s) for s in spans]], pa.list_(pa.list_(pa.int64())))], ["conv_id", "formatted", "loss_spans"])

    return _in_order(turns).mapInArrow(run, "conv_id long, formatted string, loss_spans array<array<bigint>>")


def digests(turns: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """Formats each conversation of ``turns`` (conv_id, turn, role, text; other columns are ignored) and reads it back.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.  Turns go by turn (nulls last), then
    role, then text; repeated rows are turns of their own.  Null role and null text count as empty.  A null conv_id is a
    conversation like any other.  Rows stream through in order, so a conversation of any length takes the memory of one
    turn.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, held = compile_template(template), []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) if held else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for conv, messages in _conversations(batches):
            reader = ChatReader()
            for text, mask in render(messages):
                reader.feed(text, mask)
            held.append((conv, *reader.result()))
            if len(held) == 4096:
                yield flush()
                held.clear()
        yield flush()

    return _in_order(turns).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
