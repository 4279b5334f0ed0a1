"""Chat formatting by compiled templates.

The template language has text, ``{{ expression }}``, ``{% for m in messages %}``,
``{% if %}/{% elif %}/{% else %}``, ``{% set %}`` and ``{% generation %}``. A template is
parsed into a syntax tree, constants are folded, and the tree becomes Python
closures. There is no attribute access, no call but of the listed filters, and no
loop but over the messages, so a template cannot reach anything outside its
inputs.

Rendering streams: a task holds one message and the parser state, however long
a conversation is. The formatted text is written turn by turn with marks over
the generated parts, and is read back by splitting on the control strings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut_lineage

START, END = "<|im_start|>", "<|im_end|>"

CHATML = (
    "{% for m in messages %}" + START + "{{ m.role | escape_role }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}" + END + "\n{% endfor %}"
)


def escape(s: str) -> str:
    """No control string survives: one backslash more inside every ``<|``, ``<\\|``, ``<\\\\|`` ..."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", s)


def unescape(s: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", s)


def escape_role(s: str) -> str:
    """A role on one line: ``escape`` after line ends were written as ``\\n`` and backslashes doubled."""
    return escape(s.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s))


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "escape_role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template is not well formed, or uses what the sandbox does not have."""


# --- syntax tree -----------------------------------------------------------------------------------------


@dataclass
class Const:
    value: object


@dataclass
class Name:
    path: tuple[str, ...]


@dataclass
class Op:
    op: str
    args: list


@dataclass
class Filter:
    name: str
    arg: object


@dataclass
class Out:
    expr: object


@dataclass
class If:
    arms: list  # (condition or None, body)


@dataclass
class For:
    var: str
    body: list


@dataclass
class Let:
    var: str
    expr: object


@dataclass
class Generation:
    body: list = field(default_factory=list)


_STRING = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
#: A tag ends at the first closing braces outside its strings.
_TAGS = re.compile(rf"(\{{%(?:{_STRING}|[^'\"])*?%\}}|\{{\{{(?:{_STRING}|[^'\"])*?\}}\}})", re.S)
_LEX = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)"
                  r"|(?P<op>==|!=|[|.+~()%]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expr:
    """Recursive descent: or, and, not, comparison, joining, filter, atom."""

    def __init__(self, text: str):
        self.toks, at, text = [], 0, text.strip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:at + 10]!r}")
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i = 0

    def peek(self):
        return self.toks[self.i] if self.i < len(self.toks) else ("end", "")

    def take(self, value: str | None = None):
        kind, got = self.peek()
        if value is not None and got != value:
            raise TemplateError(f"expected {value!r}, got {got!r}")
        self.i += 1
        return kind, got

    def parse(self):
        e = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return e

    def chain(self, words: tuple[str, ...], below):
        e = below()
        while self.peek()[1] in words and self.peek()[0] in ("op", "name"):
            e = Op(self.take()[1], [e, below()])
        return e

    def either(self):
        return self.chain(("or",), self.both)

    def both(self):
        return self.chain(("and",), self.negation)

    def negation(self):
        if self.peek() == ("name", "not"):
            self.take()
            return Op("not", [self.negation()])
        return self.chain(("==", "!="), self.joined)

    def joined(self):
        return self.chain(("+", "~"), self.filtered)

    def filtered(self):
        e = self.atom()
        while self.peek()[1] == "|":
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            e = Filter(name, e)
        return e

    def atom(self):
        kind, got = self.take()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), got[1:-1], flags=re.S))
        if kind == "num":
            return Const(int(got))
        if got == "(":
            e = self.either()
            self.take(")")
            return e
        if kind == "name" and got not in ("or", "and", "not"):
            if got in ("true", "false"):
                return Const(got == "true")
            path = [got]
            while self.peek()[1] == ".":
                self.take()
                kind, got = self.take()
                if kind != "name" or got.startswith("_"):
                    raise TemplateError(f"no such field {got!r}")
                path.append(got)
            if len(path) > 2 or path[0].startswith("_"):
                raise TemplateError(f"no such field {'.'.join(path)!r}")
            return Name(tuple(path))
        raise TemplateError(f"unexpected {got!r}")


def parse(source: str) -> list:
    """The template's syntax tree. A dash inside a tag's braces trims the white space of the text on that side."""
    parts = _TAGS.split(source)
    for i in range(0, len(parts), 2):  # texts stand between the tags
        if "{{" in parts[i] or "{%" in parts[i]:
            raise TemplateError(f"unclosed tag at {parts[i][-20:]!r}")
        if i and parts[i - 1][-3] == "-":
            parts[i] = parts[i].lstrip()
        if i + 1 < len(parts) and parts[i + 1][2:3] == "-":
            parts[i] = parts[i].rstrip()
    at = 0

    def body(ends: tuple[str, ...], inside: tuple[str, ...]):
        nonlocal at
        out: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if at % 2:
                if part:
                    out.append(Out(Const(part)))
                continue
            inner = part[2:-2].removeprefix("-").removesuffix("-").strip()
            if part.startswith("{{"):
                out.append(Out(_Expr(inner).parse()))
                continue
            word, _, rest = inner.partition(" ")
            if word in ends:
                return out, word, rest
            if word == "for":
                m = re.fullmatch(r"([A-Za-z]\w*) in messages", rest.strip())
                if not m or "for" in inside:
                    raise TemplateError("only one loop, over the messages, is possible")
                inner_body, _, _ = body(("endfor",), (*inside, "for"))
                out.append(For(m[1], inner_body))
            elif word == "if":
                arms, cond = [], _Expr(rest).parse()
                while True:
                    b, end, more = body(("elif", "else", "endif") if cond is not None else ("endif",), inside)
                    arms.append((cond, b))
                    if end == "endif":
                        break
                    cond = _Expr(more).parse() if end == "elif" else None
                out.append(If(arms))
            elif word == "set":
                var, _, value = rest.partition("=")
                if not re.fullmatch(r"[A-Za-z]\w*", var.strip()):
                    raise TemplateError(f"cannot set {var.strip()!r}")
                out.append(Let(var.strip(), _Expr(value).parse()))
            elif word == "generation":
                if "generation" in inside:
                    raise TemplateError("generation inside generation")
                out.append(Generation(body(("endgeneration",), (*inside, "generation"))[0]))
            else:
                raise TemplateError(f"unexpected tag {word!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, "", ""

    return body((), ())[0]


def _apply(op: str, args: list):
    if op == "==":
        return args[0] == args[1]
    if op == "!=":
        return args[0] != args[1]
    if op in "+~":
        return f"{args[0]}{args[1]}" if op == "~" or isinstance(args[0], str) or isinstance(args[1], str) else args[0] + args[1]
    if op == "not":
        return not args[0]
    return (args[0] and args[1]) if op == "and" else (args[0] or args[1])


def fold(node):
    """Constants folded: operators and filters on constants, decided branches, neighbouring texts joined."""
    if isinstance(node, list):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, Out) and isinstance(y.expr, Const) and out and isinstance(out[-1], Out) and isinstance(out[-1].expr, Const):
                    out[-1] = Out(Const(f"{out[-1].expr.value}{y.expr.value}"))
                else:
                    out.append(y)
        return out
    if isinstance(node, Op):
        args = [fold(a) for a in node.args]
        return Const(_apply(node.op, [a.value for a in args])) if all(isinstance(a, Const) for a in args) else Op(node.op, args)
    if isinstance(node, Filter):
        arg = fold(node.arg)
        return Const(FILTERS[node.name](str(arg.value))) if isinstance(arg, Const) else Filter(node.name, arg)
    if isinstance(node, Out):
        return Out(fold(node.expr))
    if isinstance(node, Let):
        return Let(node.var, fold(node.expr))
    if isinstance(node, For):
        return For(node.var, fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms = []
        for cond, b in node.arms:
            cond = fold(cond) if cond is not None else None
            if isinstance(cond, Const):
                if not cond.value:
                    continue
                cond = None
            arms.append((cond, fold(b)))
            if cond is None:
                break
        if not arms:
            return []
        return arms[0][1] if arms[0][0] is None else If(arms)
    return node


# --- closures --------------------------------------------------------------------------------------------

Pieces = Iterator[tuple[str, bool]]


def _value(e) -> Callable[[dict], object]:
    if isinstance(e, Const):
        return lambda env, v=e.value: v
    if isinstance(e, Name):
        if len(e.path) == 1:
            return lambda env, k=e.path[0]: env.get(k, "")
        return lambda env, k=e.path[0], f=e.path[1]: x.get(f, "") if isinstance(x := env.get(k), dict) else ""
    if isinstance(e, Filter):
        return lambda env, f=FILTERS[e.name], a=_value(e.arg): f(str(a(env)))
    if e.op == "and":
        return lambda env, a=_value(e.args[0]), b=_value(e.args[1]): a(env) and b(env)
    if e.op == "or":
        return lambda env, a=_value(e.args[0]), b=_value(e.args[1]): a(env) or b(env)
    args = [_value(a) for a in e.args]
    return lambda env, op=e.op, args=args: _apply(op, [a(env) for a in args])


def _block(nodes: list, generated: bool) -> Callable[[dict], Pieces]:
    steps = [_node(n, generated) for n in nodes]

    def run(env: dict) -> Pieces:
        for s in steps:
            yield from s(env)
    return run


def _node(n, generated: bool) -> Callable[[dict], Pieces]:
    if isinstance(n, Out):
        def out(env, v=_value(n.expr)):
            yield str(v(env)), generated
        return out
    if isinstance(n, Let):
        def let(env, k=n.var, v=_value(n.expr)):
            env[k] = v(env)
            return iter(())
        return let
    if isinstance(n, Generation):
        return _block(n.body, True)
    if isinstance(n, If):
        arms = [(None if c is None else _value(c), _block(b, generated)) for c, b in n.arms]

        def pick(env):
            for cond, b in arms:
                if cond is None or cond(env):
                    yield from b(env)
                    return
        return pick
    if isinstance(n, For):
        b = _block(n.body, generated)

        def loop(env, var=n.var):
            for i, m in enumerate(env["messages"]):
                yield from b(env | {var: m, "loop": {"index": i + 1, "index0": i, "first": i == 0}})
        return loop
    raise TemplateError(f"unexpected {n!r}")


def compile_template(source: str) -> Callable[[Iterable[dict]], Pieces]:
    """A function from messages (``{"role", "text"}``, any iterable, read once) to ``(text, generated)`` pieces."""
    run = _block(fold(parse(source)), False)
    return lambda messages: run({"messages": messages})


# --- Spark jobs ------------------------------------------------------------------------------------------

_FORMATTED = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("text", pa.string()),
                        ("mask", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])


def _sorted_by_conversation(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_conversations(turns: DataFrame, template: str = CHATML) -> DataFrame:
    """``(conv_id, seq, text, mask)``: a conversation's output is its texts joined in ``seq`` order; ``mask`` lists the
    generated parts of the piece in code points.

    ``turns(conv_id, turn, role, text)``, other columns are not read. Turns go in the order of ``turn`` (null
    first), ties by role, then text; repeated rows are turns of their own. Null roles and texts are empty. Rows
    without a conv_id form one conversation of their own. A conversation of any length streams through its
    task one turn at a time. An empty table gives no rows.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        render = compile_template(template)
        source = (r for part in arrow_rows(batches) for r in part)
        ahead = next(source, None)
        out: list[tuple] = []
        size = 0
        while ahead is not None:
            conv, place = ahead["conv_id"], {"n": 0}

            def messages():
                nonlocal ahead
                while ahead is not None and ahead["conv_id"] == conv:
                    now, ahead = ahead, next(source, None)
                    place["n"] += 1
                    yield {"role": now["role"], "text": now["text"]}

            text, mask, at, seq = [], [], 0, 0
            for piece, generated in render(messages()):
                if place["n"] != seq and text:  # the pieces of one turn are one row
                    out.append((conv, seq, "".join(text), mask))
                    size += at
                    text, mask, at = [], [], 0
                    if len(out) >= 1000 or size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FORMATTED.types)], names=_FORMATTED.names)
                        out, size = [], 0
                seq = place["n"]
                if generated and piece:
                    mask.append({"start": at, "length": len(piece)})
                text.append(piece)
                at += len(piece)
            out.append((conv, seq, "".join(text), mask))
            for _ in messages():  # a template without a loop leaves them unread
                pass
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FORMATTED.types)], names=_FORMATTED.names)

    return _sorted_by_conversation(rows, "turn", "role", "text").mapInArrow(
        run, "conv_id long, seq long, text string, mask array<struct<start:long,length:long>>")


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Read ChatML output back: ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``.

    Turns are found by the control strings of the output alone, the text under the loss mask by the marks; both are
    unescaped. Digests run along the pieces, so that no conversation is held whole.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        def close():
            if rest:
                raise ValueError(f"conversation {conv}: output does not end with a turn")
            return conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars

        conv, begun, out = None, False, []
        for part in arrow_rows(batches):
            for r in part:
                if not begun or r["conv_id"] != conv:
                    if begun:
                        out.append(close())
                    conv, begun, n, loss_n, chars, rest = r["conv_id"], True, 0, 0, 0, ""
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                chars += len(r["text"])
                for m in r["mask"]:
                    said = unescape(r["text"][m["start"]: m["start"] + m["length"]])
                    loss_n += len(said)
                    loss.update(said.encode())
                rest += r["text"]
                at = 0
                while m := _TURN.match(rest, at):
                    n += 1
                    turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                    at = m.end()
                rest = rest[at:]
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if begun:
            out.append(close())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return _sorted_by_conversation(formatted, "seq").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_and_read(turns: DataFrame, template: str = CHATML) -> DataFrame:
    """Write the formatted conversations as a table and read them back."""
    return read_formatted(cut_lineage(format_conversations(turns, template), "chat"))
