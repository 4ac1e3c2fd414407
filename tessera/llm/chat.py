"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are
folded, and the tree becomes nested Python closures: no ``eval``, no attribute
access on anything but the given dictionaries, no calls but the listed filters.

    {{ expression }}                      output
    {% for x in list %} ... {% endfor %}  loops (``loop.index0``, ``loop.first``, ``loop.last``)
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = e %}
    {% generation %} ... {% endgeneration %}   marks what a model is to learn
    {# comment #}; a ``-`` inside a tag trims the white space beside it
    expressions: strings, integers, true false none, names, a.b, a['b'], a[0],
    + ~ == != < > <= >= in, and or not, e | filter (trim, upper, lower, length, escape)

Defined cases: null role or text counts as empty; turns go by number, then role,
then text, nulls first, repeated rows each being a turn; a null id is a
conversation; without rows there is no conversation; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import partitions, small_batches

#: Strings with a meaning in a formatted conversation.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[IS]")
TEMPLATE = """
{%- for m in messages -%}
{%- if m.role == 'user' -%}<s>[INST]{{ m.content | escape }}[/INST]
{%- elif m.role == 'assistant' -%}<s>{% generation %}{{ m.content | escape }}{% endgeneration %}</s>
{%- elif m.role == 'system' -%}<s><<SYS>>{{ m.content | escape }}<</SYS>>
{%- else -%}<s>[ROLE]{{ m.role | escape }}[IS]{{ m.content | escape }}[/ROLE]
{%- endif -%}
{%- endfor -%}
"""


class TemplateError(ValueError):
    """The template is not of the language above."""


# ------------------------------------------------------------------ escapes


def _pattern(control: tuple[str, ...], marked: str) -> re.Pattern:
    return re.compile("(" + "|".join(sorted({re.escape(c[0]) for c in control})) + rf")({marked})(?=(" + "|".join(re.escape(c[1:]) for c in sorted(control, key=len, reverse=True)) + "))")


_ESCAPE = _pattern(CONTROL, r"\\*")
_UNESCAPE = _pattern(CONTROL, r"\\+")


def escape(text: str) -> str:
    """A control string gets a backslash behind its first character, one more than it may have there."""
    return _ESCAPE.sub(lambda m: f"{m[1]}\\{m[2]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] + m[2][1:], text)


FILTERS: dict[str, Callable] = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": lambda x: _length(x), "escape": lambda x: escape(_text(x))}


def _length(x: Any) -> int:
    if not isinstance(x, str | list | dict):
        raise TemplateError("length takes a string, a list or a map")
    return len(x)


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else {True: "true", False: "false"}[x] if isinstance(x, bool) else str(x)


# ------------------------------------------------------------------ syntax tree


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Item:
    of: Any
    key: Any


@dataclass
class Binary:
    op: str
    left: Any
    right: Any


@dataclass
class Not:
    of: Any


@dataclass
class Filter:
    name: str
    of: Any


@dataclass
class Out:
    of: Any


@dataclass
class For:
    name: str
    of: Any
    body: list


@dataclass
class If:
    arms: list  # (condition, body)


@dataclass
class Set:
    name: str
    of: Any


@dataclass
class Generation:
    body: list


_TAG = re.compile(r"\{#.*?#\}|\{\{.*?\}\}|\{%.*?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.\[\]()]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over one tag's tokens."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> bool:
        kind, value = self.peek()
        if kind != "str" and value in values:
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected, {self.peek()[1]!r} found")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"a name expected, {value!r} found")
        self.at += 1
        return value

    def whole(self) -> Any:
        out = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def either(self) -> Any:
        out = self.both()
        while self.take("or"):
            out = Binary("or", out, self.both())
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.take("and"):
            out = Binary("and", out, self.negated())
        return out

    def negated(self) -> Any:
        return Not(self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        out = self.summed()
        kind, op = self.peek()
        if kind != "str" and op in ("==", "!=", "<", ">", "<=", ">=", "in"):
            self.at += 1
            out = Binary(op, out, self.summed())
        return out

    def summed(self) -> Any:
        out = self.piped()
        while self.peek()[1] in ("+", "~") and self.peek()[0] == "op":
            op = self.peek()[1]
            self.at += 1
            out = Binary(op, out, self.piped())
        return out

    def piped(self) -> Any:
        out = self.atom()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Filter(name, out)
        return out

    def atom(self) -> Any:
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            out: Any = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "int":
            out = Const(int(value))
        elif kind == "name":
            out = Const({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
        elif value == "(":
            out = self.either()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while True:
            if self.take("."):
                out = Item(out, Const(self.name()))
            elif self.take("["):
                out = Item(out, self.either())
                self.need("]")
            else:
                return out


def parse(source: str) -> list:
    """The template as a list of nodes."""
    pieces, at, trim = [], 0, False
    for m in _TAG.finditer(source):
        text, tag = source[at : m.start()], m[0]
        inner = tag[2:-2]
        if trim:
            text = text.lstrip()
        if inner.startswith("-"):
            text, inner = text.rstrip(), inner[1:]
        trim = inner.endswith("-") and not tag.startswith("{#")
        if trim:
            inner = inner[:-1]
        if text:
            pieces.append(("text", text))
        if not tag.startswith("{#"):
            pieces.append(("out" if tag.startswith("{{") else "do", inner.strip()))
        at = m.end()
    rest = source[at:].lstrip() if trim else source[at:]
    if rest:
        pieces.append(("text", rest))
    for kind, text in pieces:
        if kind == "text" and re.search(r"\{[{%]", text):
            raise TemplateError("a tag is not closed")
    body, left = _block(pieces, 0, ())
    if left != len(pieces):
        raise TemplateError(f"unexpected {pieces[left][1]!r}")
    return body


def _block(pieces: list, at: int, until: tuple[str, ...]) -> tuple[list, int]:
    out: list = []
    while at < len(pieces):
        kind, text = pieces[at]
        if kind == "text":
            out.append(Out(Const(text)))
            at += 1
            continue
        if kind == "out":
            out.append(Out(_Expression(text).whole()))
            at += 1
            continue
        word, _, rest = text.partition(" ")
        if word in until:
            return out, at
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"malformed for: {rest!r}")
            body, at = _block(pieces, at + 1, ("endfor",))
            out.append(For(m[1], _Expression(m[2]).whole(), body))
        elif word == "if":
            arms, condition = [], _Expression(rest).whole()
            while True:
                body, at = _block(pieces, at + 1, ("elif", "else", "endif"))
                arms.append((condition, body))
                word, _, rest = (pieces[at][1] if at < len(pieces) else "").partition(" ")
                if word != "elif":
                    break
                condition = _Expression(rest).whole()
            if word == "else":
                body, at = _block(pieces, at + 1, ("endif",))
                arms.append((Const(True), body))
            out.append(If(arms))
        elif word == "set":
            name, eq, value = rest.partition("=")
            if not eq or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                raise TemplateError(f"malformed set: {rest!r}")
            out.append(Set(name.strip(), _Expression(value).whole()))
        elif word == "generation":
            body, at = _block(pieces, at + 1, ("endgeneration",))
            out.append(Generation(body))
        else:
            raise TemplateError(f"unexpected {text!r}")
        if at >= len(pieces):
            raise TemplateError(f"{word!r} is not closed")
        at += 1
    if until:
        raise TemplateError(f"{until[-1]!r} is missing")
    return out, at


# ------------------------------------------------------------------ folding and closures


def _apply(op: str, a: Any, b: Any) -> Any:
    if op == "~":
        return _text(a) + _text(b)
    if op == "+":
        if type(a) is type(b) and isinstance(a, str | int):
            return a + b
        raise TemplateError("+ takes two strings or two integers")
    if op == "in":
        return a in b if isinstance(b, str | list | dict) else False
    if op in ("<", ">", "<=", ">=") and not (type(a) is type(b) and isinstance(a, str | int)):
        raise TemplateError(f"{op} takes two strings or two integers")
    return {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b}[op]()


def fold(node: Any) -> Any:
    """The same tree with constant parts computed, dead arms gone and neighbouring texts joined."""
    if isinstance(node, list):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, Out) and isinstance(y.of, Const):
                    text = _text(y.of.value)
                    if out and isinstance(out[-1], Out) and isinstance(out[-1].of, Const):
                        out[-1] = Out(Const(out[-1].of.value + text))
                    elif text:
                        out.append(Out(Const(text)))
                else:
                    out.append(y)
        return out
    if isinstance(node, Binary):
        a, b = fold(node.left), fold(node.right)
        if isinstance(a, Const) and node.op in ("and", "or"):
            return b if bool(a.value) == (node.op == "and") else a
        if isinstance(a, Const) and isinstance(b, Const):
            return Const(_apply(node.op, a.value, b.value))
        return Binary(node.op, a, b)
    if isinstance(node, Not):
        of = fold(node.of)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Out):
        return Out(fold(node.of))
    if isinstance(node, Set):
        return Set(node.name, fold(node.of))
    if isinstance(node, For):
        return For(node.name, fold(node.of), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms = []
        for condition, body in node.arms:
            condition = fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            arms.append((condition, fold(body)))
            if isinstance(condition, Const):
                break
        if not arms:
            return []
        return arms[0][1] if isinstance(arms[0][0], Const) else If(arms)
    return node


def _value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)

        def item(env: dict) -> Any:
            a, k = of(env), key(env)
            if isinstance(a, dict):
                return a.get(k)
            if isinstance(a, list | str) and isinstance(k, int):
                return a[k] if -len(a) <= k < len(a) else None
            return None

        return item
    if isinstance(node, Not):
        of = _value(node.of)
        return lambda env: not of(env)
    if isinstance(node, Filter):
        f, of = FILTERS[node.name], _value(node.of)
        return lambda env: f(of(env))
    a, b, op = _value(node.left), _value(node.right), node.op
    if op == "and":
        return lambda env: a(env) and b(env)
    if op == "or":
        return lambda env: a(env) or b(env)
    return lambda env: _apply(op, a(env), b(env))


@dataclass
class Rendered:
    """Parts of the output in order; ``marks`` are numbers of the parts that a model is to learn."""

    parts: list[str] = field(default_factory=list)
    marks: set[int] = field(default_factory=set)
    learning: bool = False

    def put(self, text: str) -> None:
        if self.learning:
            self.marks.add(len(self.parts))
        self.parts.append(text)

    def text(self) -> str:
        return "".join(self.parts)

    def spans(self) -> list[tuple[int, int]]:
        """Marked spans as code point offsets, one for each marked part that is not empty."""
        out, at = [], 0
        for k, x in enumerate(self.parts):
            if k in self.marks and x:
                out.append((at, at + len(x)))
            at += len(x)
        return out


def _run(body: list) -> Callable[[dict, Rendered], None]:
    steps = [_step(x) for x in body]

    def run(env: dict, to: Rendered) -> None:
        for f in steps:
            f(env, to)

    return run


def _step(node: Any) -> Callable[[dict, Rendered], None]:
    if isinstance(node, Out):
        if isinstance(node.of, Const):
            text = _text(node.of.value)
            return lambda env, to: to.put(text)
        of = _value(node.of)
        return lambda env, to: to.put(_text(of(env)))
    if isinstance(node, Set):
        name, of = node.name, _value(node.of)

        def put(env: dict, to: Rendered) -> None:
            env[name] = of(env)

        return put
    if isinstance(node, Generation):
        inner = _run(node.body)

        def learn(env: dict, to: Rendered) -> None:
            before, to.learning = to.learning, True
            inner(env, to)
            to.learning = before

        return learn
    if isinstance(node, If):
        arms = [(_value(c), _run(b)) for c, b in node.arms]

        def choose(env: dict, to: Rendered) -> None:
            for c, b in arms:
                if c(env):
                    b(env, to)
                    return

        return choose
    name, of, body = node.name, _value(node.of), _run(node.body)

    def loop(env: dict, to: Rendered) -> None:
        items = of(env)
        items = items if isinstance(items, list) else []
        inner = dict(env)  # names set inside a loop end with it
        for k, x in enumerate(items):
            inner[name] = x
            inner["loop"] = {"index0": k, "index": k + 1, "first": k == 0, "last": k == len(items) - 1, "length": len(items)}
            body(inner, to)

    return loop


class Template:
    def __init__(self, source: str = TEMPLATE):
        self.tree = fold(parse(source))
        self._render = _run(self.tree)

    def render(self, messages: list[dict], **names: Any) -> Rendered:
        out = Rendered()
        self._render({"messages": messages, **names}, out)
        return out


# ------------------------------------------------------------------ reading back

_MARK = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a conversation in the format of ``TEMPLATE``."""
    turns: list[tuple[str, str]] = []
    pieces, marks = _MARK.split(text), _MARK.findall(text)
    k = 0
    while k < len(marks):
        if marks[k] != "<s>":
            raise ValueError(f"<s> expected, {marks[k]} found")
        after = marks[k + 1] if k + 1 < len(marks) else ""
        if after == "</s>":
            turns.append(("assistant", unescape(pieces[k + 1])))
            k += 2
        elif after == "[ROLE]":
            turns.append((unescape(pieces[k + 2]), unescape(pieces[k + 3])))
            k += 4
        else:
            turns.append(({"[INST]": "user", "<<SYS>>": "system"}[after], unescape(pieces[k + 2])))
            k += 3
    return turns


def format_conversations(turns: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """``turns`` (``conv_id, turn, role, text``) to ``conv_id, formatted, spans``.

    ``spans``: the code points under the loss mask, ``array<struct<begin, end>>``."""
    Template(source)  # a malformed template fails here, on the driver
    spark = turns.sparkSession
    small_batches(spark)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark, 0)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source)
        each = ((c, {"role": r, "content": t}) for b in batches for c, r, t in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True))
        out: list[tuple] = []
        size = 0
        for conv, own in groupby(each, key=lambda x: x[0]):
            r = template.render([m for _, m in own])
            out.append((conv, r.text(), [{"begin": a, "end": b} for a, b in r.spans()]))
            size += len(out[-1][1])
            if size > 4_000_000:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], kind)], ["conv_id", "formatted", "spans"])

    dealt = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(formatted, "conv_id long, formatted string, spans array<struct<begin: long, end: long>>")


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted text and its spans hold, read back from them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, text, spans in zip(*(b.column(k).to_pylist() for k in ("conv_id", "formatted", "spans")), strict=True):
                turns, sha = read_back(text), hashlib.sha256()
                for role, content in turns:
                    sha.update(f"{role}\n{content}\n".encode())
                learned = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                out.append((conv, len(turns), sha.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    return conversations.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
