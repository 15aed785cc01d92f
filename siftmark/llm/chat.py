"""Chat formatting with a small, sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested Python closures that yield
output segments and whether each lies under the loss mask. A template sees ``messages`` and nothing else:
names and attributes are looked up in plain mappings, there are no calls, and unknown names are errors at
compile time. Statements: ``for .. in ..``, ``if / elif / else``, ``generation``; expressions: strings, names, attributes,
``==``, ``!=``, ``and``, ``or``, ``not``, ``+`` and the filters ``escape``, ``trim``, ``lower``, ``upper``.

Messages are consumed one by one while rendering, so a conversation of any length is formatted in a stream: rows are dealt by
conversation and sorted by turn, and a task holds one turn at a time.

Defined results: turns of one conversation are ordered by turn, then role, then text (nulls first), repeated rows are turns of
their own; null texts and roles are empty strings; rows without conversation id form one conversation; empty texts give
empty turns; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import arrow_rows

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ASST]", "[TURN]", "[TEXT]", "[/TURN]"]
TEMPLATE = (
    "{% for m in messages %}"
    '{% if m.role == "assistant" %}[ASST]{% generation %}{{ m.text | escape }}{% endgeneration %}</s>'
    '{% elif m.role == "user" %}<s>[INST]{{ m.text | escape }}[/INST]'
    "{% else %}[TURN]{{ m.role | escape }}[TEXT]{{ m.text | escape }}[/TURN]{% endif %}"
    "{% endfor %}"
)

_ESCAPED = {"\\": "\\b", "<": "\\l", "[": "\\o"}
_PLAIN = {v[1]: k for k, v in _ESCAPED.items()}
_TO_ESCAPE = re.compile(r"\\|[<\[](?=" + "|".join(sorted({re.escape(c[1:]) for c in CONTROLS})) + ")")


def escape(text: str) -> str:
    """The text without control strings: their first character, and every backslash, is spelt with a backslash."""
    return _TO_ESCAPE.sub(lambda m: _ESCAPED[m.group()], text)


def unescape(text: str) -> str:
    return re.sub(r"\\([blo])", lambda m: _PLAIN[m.group(1)], text)


class TemplateError(ValueError):
    pass


# Syntax tree ---------------------------------------------------------------------------------------


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str
    path: list[str]


@dataclass
class Op:
    op: str
    args: list


@dataclass
class Out:
    value: object


@dataclass
class For:
    name: str
    items: Name
    body: list


@dataclass
class If:
    arms: list[tuple]


@dataclass
class Generation:
    body: list


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "lower": str.lower, "upper": str.upper}
_LEX = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(==|!=|[+|()]))""")
_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)


class _Expression:
    """Recursive descent over the tokens of one expression, loosest operator first."""

    def __init__(self, source: str, names: set[str]):
        self.source, self.names, self.tokens, at = source, names, [], 0
        while source[at:].strip():
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(m.groups())
            at = m.end()

    def parse(self):
        out = self._either("or")
        if self.tokens:
            raise TemplateError(f"more than one expression in {self.source!r}")
        return out

    def _next_is(self, *words: str) -> str | None:
        head = self.tokens[0] if self.tokens else (None, None, None)
        found = head[1] or head[2]
        return found if found in words else None

    def _either(self, word: str):
        lower = (lambda: self._either("and")) if word == "or" else self._negated
        args = [lower()]
        while self._next_is(word):
            self.tokens.pop(0)
            args.append(lower())
        return args[0] if len(args) == 1 else Op(word, args)

    def _negated(self):
        if self._next_is("not"):
            self.tokens.pop(0)
            return Op("not", [self._negated()])
        left = self._sum()
        if op := self._next_is("==", "!="):
            self.tokens.pop(0)
            return Op(op, [left, self._sum()])
        return left

    def _sum(self):
        args = [self._filtered()]
        while self._next_is("+"):
            self.tokens.pop(0)
            args.append(self._filtered())
        return args[0] if len(args) == 1 else Op("+", args)

    def _filtered(self):
        out = self._atom()
        while self._next_is("|"):
            self.tokens.pop(0)
            name = self.tokens.pop(0)[1] if self.tokens else None
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Op(name, [out])
        return out

    def _atom(self):
        if not self.tokens:
            raise TemplateError(f"expression ends early: {self.source!r}")
        text, name, sign = self.tokens.pop(0)
        if text is not None:
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m.group(1), m.group(1)), text[1:-1], flags=re.S))
        if name is not None:
            head, *path = name.split(".")
            if head in ("true", "false") and not path:
                return Const(head == "true")
            if head not in self.names or any(p.startswith("_") for p in path):
                raise TemplateError(f"no name {name!r}")
            return Name(head, path)
        if sign == "(":
            out = self._either("or")
            if not self._next_is(")"):
                raise TemplateError("a bracket is not closed")
            self.tokens.pop(0)
            return out
        raise TemplateError(f"unexpected {sign!r}")


def parse(source: str) -> list:
    """The syntax tree of a template."""
    parts = [p for p in _PARTS.split(source) if p and not p.startswith("{#")]

    def block(names: set[str], ends: tuple[str, ...]) -> tuple[list, str]:
        body: list = []
        while parts:
            part = parts.pop(0)
            if part.startswith("{{"):
                body.append(Out(_Expression(part[2:-2], names).parse()))
            elif part.startswith("{%"):
                inner = part[2:-2].strip()
                word, _, rest = inner.partition(" ")
                if word in ends:
                    return body, inner
                body.append(statement(word, rest.strip(), names))
            else:
                body.append(Out(Const(part)))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return body, ""

    def statement(word: str, rest: str, names: set[str]):
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(\S+)", rest)
            if not m:
                raise TemplateError(f"cannot read for {rest!r}")
            items = _Expression(m[2], names).parse()
            if not isinstance(items, Name):
                raise TemplateError("only a name can be looped over")
            return For(m[1], items, block(names | {m[1]}, ("endfor",))[0])
        if word == "if":
            arms, test = [], _Expression(rest, names).parse()
            while True:
                body, end = block(names, ("elif", "else", "endif"))
                arms.append((test, body))
                if end == "endif":
                    return If(arms)
                if end == "else":
                    arms.append((Const(True), block(names, ("endif",))[0]))
                    return If(arms)
                test = _Expression(end[4:], names).parse()
        if word == "generation":
            return Generation(block(names, ("endgeneration",))[0])
        raise TemplateError(f"no statement {word!r}")

    return block({"messages"}, ())[0]


def _apply(op: str, values: list):
    if op == "==":
        return values[0] == values[1]
    if op == "!=":
        return values[0] != values[1]
    if op == "not":
        return not values[0]
    if op in ("and", "or"):
        return all(values) if op == "and" else any(values)
    if op == "+":
        return "".join(map(str, values))
    return FILTERS[op](str(values[0]))


def fold(node):
    """The tree with constant expressions evaluated, dead branches removed and neighbouring texts joined."""
    if isinstance(node, list):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, Out) and isinstance(y.value, Const):
                    if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                        out[-1] = Out(Const(str(out[-1].value.value) + str(y.value.value)))
                        continue
                    if y.value.value == "":
                        continue
                out.append(y)
        return out
    if isinstance(node, Op):
        args = [fold(a) for a in node.args]
        return Const(_apply(node.op, [a.value for a in args])) if all(isinstance(a, Const) for a in args) else Op(node.op, args)
    if isinstance(node, Out):
        return Out(fold(node.value))
    if isinstance(node, For):
        return For(node.name, node.items, fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms = []
        for test, body in node.arms:
            test = fold(test)
            if isinstance(test, Const) and not test.value:
                continue
            arms.append((test, fold(body)))
            if isinstance(test, Const):
                break
        if not arms:
            return []
        return arms[0][1] if isinstance(arms[0][0], Const) else If(arms)
    return node


Segments = Iterator[tuple[str, bool]]


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope: node.value
    if isinstance(node, Name):

        def look(scope: dict):
            found = scope[node.name]
            for key in node.path:
                found = found[key]
            return found

        return look
    args = [_value(a) for a in node.args]
    return lambda scope: _apply(node.op, [a(scope) for a in args])


def _emitter(body: list, masked: bool) -> Callable[[dict], Segments]:
    steps = []
    for node in body:
        if isinstance(node, Out):
            steps.append(_emit_value(_value(node.value), masked))
        elif isinstance(node, Generation):
            steps.append(_emitter(node.body, True))
        elif isinstance(node, For):
            steps.append(_emit_loop(node.name, _value(node.items), _emitter(node.body, masked)))
        else:
            steps.append(_emit_choice([(_value(t), _emitter(b, masked)) for t, b in node.arms]))

    def run(scope: dict) -> Segments:
        for step in steps:
            yield from step(scope)

    return run


def _emit_value(value: Callable, masked: bool) -> Callable[[dict], Segments]:
    def run(scope: dict) -> Segments:
        yield str(value(scope)), masked

    return run


def _emit_loop(name: str, items: Callable, body: Callable) -> Callable[[dict], Segments]:
    def run(scope: dict) -> Segments:
        for item in items(scope):
            yield from body({**scope, name: item})

    return run


def _emit_choice(arms: list[tuple[Callable, Callable]]) -> Callable[[dict], Segments]:
    def run(scope: dict) -> Segments:
        for test, body in arms:
            if test(scope):
                yield from body(scope)
                return

    return run


def compile_template(source: str = TEMPLATE) -> Callable[[Iterable[dict]], Segments]:
    """A function from messages (mappings of role and text) to segments (text, under the loss mask)."""
    run = _emitter(fold(parse(source)), False)
    return lambda messages: run({"messages": messages})


# Rendering and reading back ------------------------------------------------------------------------


def render(run: Callable, messages: Iterable[dict]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Output by turn: the text that follows from a message, and its masked ranges."""
    pulled = 0

    def counted() -> Iterator[dict]:
        nonlocal pulled
        for message in messages:
            pulled += 1
            yield message

    text, spans, turn = "", [], 0
    for piece, masked in run(counted()):
        if pulled > max(turn, 1):
            yield text, spans
            text, spans = "", []
        turn = pulled
        if masked:
            if spans and spans[-1][1] == len(text):
                spans[-1] = (spans[-1][0], len(text) + len(piece))
            else:
                spans.append((len(text), len(text) + len(piece)))
        text += piece
    if text or turn:
        yield text, spans


@dataclass
class Reader:
    """Reads turns back from formatted output of the default template, in pieces of any size."""

    buffer: str = ""
    turns: int = 0
    digest: object = field(default_factory=hashlib.sha256)

    _OPEN = {"<s>[INST]": ("user", "[/INST]"), "[ASST]": ("assistant", "</s>"), "[TURN]": (None, "[/TURN]")}

    def feed(self, text: str) -> None:
        self.buffer += text
        at = 0
        while at < len(self.buffer):
            opened = next((o for o in self._OPEN if self.buffer.startswith(o, at)), None)
            if opened is None:
                break
            role, closing = self._OPEN[opened]
            end = self.buffer.find(closing, at + len(opened))
            if end < 0:
                break
            body = self.buffer[at + len(opened) : end]
            if role is None:
                role, _, body = body.partition("[TEXT]")
                role = unescape(role)
            self.digest.update(f"{role}\n{unescape(body)}\n".encode())
            self.turns += 1
            at = end + len(closing)
        self.buffer = self.buffer[at:]


def _turn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for ids, roles, texts in arrow_rows(batches, ["conv_id", "role", "text"]):
        yield from zip(ids, roles, texts)


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """A row per turn, in order within each conversation: conv_id, position, formatted, loss (ranges in it)."""
    compile_template(template)  # errors show before the job

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rendering = compile_template(template)
        schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        held: list[dict] = []
        for conv, rows in groupby(_turn_rows(batches), key=lambda r: r[0]):
            messages = ({"role": r or "", "text": t or ""} for _, r, t in rows)
            for position, (text, spans) in enumerate(render(rendering, messages)):
                held.append({"conv_id": conv, "position": position, "formatted": text, "loss": [{"start": a, "end": b} for a, b in spans]})
                if len(held) >= 512:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, position long, formatted string, loss array<struct<start:int,end:int>>")


def read_back(output: DataFrame) -> DataFrame:
    """Digests per conversation, from formatted rows as they come: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        rows = chain.from_iterable(zip(*columns) for columns in arrow_rows(batches, ["conv_id", "formatted", "loss"]))
        for conv, turns in groupby(rows, key=lambda r: r[0]):
            reader, loss, loss_chars, chars = Reader(), hashlib.sha256(), 0, 0
            for _, text, spans in turns:
                reader.feed(text)
                chars += len(text)
                for span in spans:
                    plain = unescape(text[span["start"] : span["end"]])
                    loss_chars += len(plain)
                    loss.update(plain.encode())
            out.append((conv, reader.turns, reader.digest.hexdigest(), loss_chars, loss.hexdigest(), chars))
        columns = list(zip(*out)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return output.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
