"""Chat formatting by a small template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree
becomes Python closures that yield pieces of the formatted conversation, each
with a flag that says whether it lies in a generation block (the loss mask).
The language is closed: it reads the variables it is given, by dictionary key or
list place, and calls the filters listed here; it has no attributes of Python
objects, no calls and no loops but those over given lists.

    {{ expression }}   {% if %} {% elif %} {% else %} {% endif %}   {% for x in y %} {% endfor %}
    {% set name = expression %}   {% generation %} {% endgeneration %}   {# comment #}   a dash trims blanks

Messages are consumed one by one, so a conversation of any length streams through
a task: turns come sorted, pieces are hashed and read back as they appear.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Control strings in texts
# ---------------------------------------------------------------------------

#: strings that mark turns in the default template
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")


def escaper(controls: Iterable[str] = CONTROLS) -> Callable[[str], str]:
    """Doubles backslashes and puts one after the first character of every control string."""
    inner = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in sorted(controls, key=len, reverse=True))
    at = re.compile(inner)
    return lambda text: at.sub(r"\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


# ---------------------------------------------------------------------------
# Syntax tree
# ---------------------------------------------------------------------------

class TemplateError(ValueError):
    """The template is not part of the language."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    base: object
    key: object


@dataclass(frozen=True)
class Apply:
    """An operator or filter on its arguments; `and`, `or`, `if` take their arguments unevaluated."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Choice:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    source: object
    body: tuple


@dataclass(frozen=True)
class Let:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


def as_text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


STRICT: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "-": operator.sub, "*": operator.mul,
    "%": operator.mod, "//": operator.floordiv, "+": lambda a, b: a + b, "~": lambda a, b: as_text(a) + as_text(b), "in": lambda a, b: a in b,
    "not": operator.not_, "neg": operator.neg,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda v: as_text(v).strip(), "upper": lambda v: as_text(v).upper(), "lower": lambda v: as_text(v).lower(), "length": lambda v: len(v), "string": as_text,
    "escape": escaper(), "default": lambda v, d="": d if v is None else v, "replace": lambda v, a, b: as_text(v).replace(a, b), "first": lambda v: v[0], "last": lambda v: v[-1],
}
#: results of repeated texts stay below this length
MOST_REPEATED = 10_000


def _times(a, b):
    if isinstance(a, str) or isinstance(b, str):
        text, n = (a, b) if isinstance(a, str) else (b, a)
        if not isinstance(n, int) or len(text) * n > MOST_REPEATED:
            raise TemplateError("a repeated text is too long")
    return a * b


STRICT["*"] = _times

TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*%~<>()\[\].,|]))", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


class _Expression:
    """Parser of one expression, by binding strength."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("~",), ("+", "-"), ("*", "//", "%"))

    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.tokens.append(next((k, v) for k, v in zip(("int", "str", "name", "op"), m.groups()) if v is not None))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, *values):
        if self.peek()[0] in ("op", "name") and self.peek()[1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value):
        if not self.take(value):
            raise TemplateError(f"{value} is missing")

    def whole(self):
        e = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return e

    def choice(self):
        e = self.level(0)
        if self.take("if"):
            test = self.level(0)
            other = self.choice() if self.take("else") else Const(None)
            return Apply("if", (test, e, other))
        return e

    def level(self, k):
        if k == len(self.LEVELS):
            return self.unary()
        if self.LEVELS[k] == ("not",):
            return Apply("not", (self.level(k),)) if self.take("not") else self.level(k + 1)
        e = self.level(k + 1)
        while True:
            op = self.take(*self.LEVELS[k])
            if op is None and "in" in self.LEVELS[k] and self.peek() == ("name", "not") and self.tokens[self.at + 1: self.at + 2] == [("name", "in")]:
                self.at += 2
                e = Apply("not", (Apply("in", (e, self.level(k + 1))),))
            elif op is None:
                return e
            else:
                e = Apply(op, (e, self.level(k + 1)))

    def unary(self):
        if self.take("-"):
            return Apply("neg", (self.unary(),))
        e = self.primary()
        while True:
            if self.take("."):
                kind, name = self.peek()
                if kind != "name":
                    raise TemplateError("a name is missing after the dot")
                self.at += 1
                e = Item(e, Const(name))
            elif self.take("["):
                e = Item(e, self.choice())
                self.need("]")
            elif self.take("|"):
                kind, name = self.peek()
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter {name!r}")
                self.at += 1
                e = Apply("|" + name, (e, *(self.arguments() if self.take("(") else ())))
            else:
                return e

    def arguments(self):
        out = []
        while not self.take(")"):
            out.append(self.choice())
            if not self.take(","):
                self.need(")")
                break
        return tuple(out)

    def primary(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "int":
            return Const(int(value))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        if kind == "name":
            return Const({"true": True, "false": False, "none": None}[value.lower()]) if value.lower() in ("true", "false", "none") else Name(value)
        if value == "(":
            e = self.choice()
            self.need(")")
            return e
        raise TemplateError(f"unexpected {value!r}")


TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)


def parse(source: str) -> tuple:
    """The template's syntax tree: a tuple of nodes."""
    parts = TAG.split(source)
    for i in range(1, len(parts), 2):
        if parts[i][2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[tuple, str, str]:
        nonlocal at
        nodes = []
        while at < len(parts):
            part, tag = parts[at], at % 2
            at += 1
            if not tag:
                if part:
                    nodes.append(Output(Const(part)))
            elif part.startswith("{{"):
                nodes.append(Output(_Expression(part[2:-2].strip("-")).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip("-").strip().partition(" ")
                if word in ends:
                    return tuple(nodes), word, rest
                nodes.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(nodes), "", ""

    def statement(word: str, rest: str):
        if word == "if":
            test = _Expression(rest).whole()
            yes, end, more = block(("elif", "else", "endif"))
            no = (statement("if", more),) if end == "elif" else block(("endif",))[0] if end == "else" else ()
            return Choice(test, yes, no)
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read for {rest}")
            return Loop(m[1], _Expression(m[2]).whole(), block(("endfor",))[0])
        if word == "set":
            name, _, value = rest.partition("=")
            return Let(name.strip(), _Expression(value).whole())
        if word == "generation":
            return Generation(block(("endgeneration",))[0])
        raise TemplateError(f"unknown statement {word!r}")

    return block(())[0]


# ---------------------------------------------------------------------------
# Constants
# ---------------------------------------------------------------------------

def fold(node):
    """The same expression with constant parts evaluated."""
    if isinstance(node, Item):
        return Item(fold(node.base), fold(node.key))
    if not isinstance(node, Apply):
        return node
    args = tuple(fold(a) for a in node.args)
    if node.op == "if" and isinstance(args[0], Const):
        return args[1] if args[0].value else args[2]
    if node.op in ("and", "or") and isinstance(args[0], Const):
        return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
    if node.op not in ("if", "and", "or") and all(isinstance(a, Const) for a in args):
        return Const(_function(node.op)(*[a.value for a in args]))
    return Apply(node.op, args)


def fold_block(nodes: tuple) -> tuple:
    """Folds all expressions, drops branches that are never taken and joins neighbouring constant outputs."""
    out: list = []
    for n in nodes:
        if isinstance(n, Output):
            n = Output(fold(n.value))
            if isinstance(n.value, Const):
                text = as_text(n.value.value)
                if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                    text = out.pop().value.value + text
                if text:
                    out.append(Output(Const(text)))
                continue
        elif isinstance(n, Choice):
            test = fold(n.test)
            if isinstance(test, Const):
                out = list(fold_block((*out, *(n.yes if test.value else n.no))))
                continue
            n = Choice(test, fold_block(n.yes), fold_block(n.no))
        elif isinstance(n, Loop):
            n = Loop(n.name, fold(n.source), fold_block(n.body))
        elif isinstance(n, Let):
            n = Let(n.name, fold(n.value))
        elif isinstance(n, Generation):
            n = Generation(fold_block(n.body))
        out.append(n)
    return tuple(out)


# ---------------------------------------------------------------------------
# Closures
# ---------------------------------------------------------------------------

Env = dict
Pieces = Iterator[tuple[str, bool]]


def _function(op: str) -> Callable:
    return FILTERS[op[1:]] if op[0] == "|" else STRICT[op]


def _look(base, key):
    if isinstance(base, dict):
        return base.get(key)
    if isinstance(base, (list, tuple, str)) and isinstance(key, int):
        return base[key] if -len(base) <= key < len(base) else None
    if base is None:
        return None
    raise TemplateError(f"{key!r} cannot be read here")


def compile_expression(node) -> Callable[[Env], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Item):
        base, key = compile_expression(node.base), compile_expression(node.key)
        return lambda env: _look(base(env), key(env))
    args = [compile_expression(a) for a in node.args]
    if node.op == "if":
        test, yes, no = args
        return lambda env: yes(env) if test(env) else no(env)
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    f = _function(node.op)
    if len(args) == 1:
        one = args[0]
        return lambda env: f(one(env))
    return lambda env: f(*[a(env) for a in args])


def compile_block(nodes: tuple, masked: bool = False) -> Callable[[Env], Pieces]:
    parts = [compile_node(n, masked) for n in nodes]

    def run(env: Env) -> Pieces:
        for p in parts:
            yield from p(env)

    return run


def compile_node(node, masked: bool) -> Callable[[Env], Pieces]:
    if isinstance(node, Output):
        value = compile_expression(node.value)

        def output(env):
            yield as_text(value(env)), masked

        return output
    if isinstance(node, Choice):
        test, yes, no = compile_expression(node.test), compile_block(node.yes, masked), compile_block(node.no, masked)
        return lambda env: yes(env) if test(env) else no(env)
    if isinstance(node, Let):
        value, name = compile_expression(node.value), node.name

        def let(env):
            env[name] = value(env)
            return iter(())

        return let
    if isinstance(node, Generation):
        return compile_block(node.body, True)
    source, body, name = compile_expression(node.source), compile_block(node.body, masked), node.name

    def loop(env):
        items, index = iter(source(env) or ()), 0
        ahead = next(items, _END)
        while ahead is not _END:
            item, ahead = ahead, next(items, _END)
            yield from body(env | {name: item, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": ahead is _END}})
            index += 1

    return loop


_END = object()


def compile_template(source: str) -> Callable[[Env], Pieces]:
    """A function of the variables that yields (text, in a generation block)."""
    return compile_block(fold_block(parse(source)))


def render(template: Callable[[Env], Pieces], **variables) -> tuple[str, list[tuple[int, int]]]:
    """The whole text and the spans of its generation blocks, neighbouring pieces of one block joined."""
    out, spans, at = [], [], 0
    before = False
    for text, masked in template(dict(variables)):
        if masked and text:
            if before and spans:
                spans[-1] = (spans[-1][0], at + len(text))
            else:
                spans.append((at, at + len(text)))
        before = masked if text else before and masked
        out.append(text)
        at += len(text)
    return "".join(out), spans


# ---------------------------------------------------------------------------
# The default format and its reader
# ---------------------------------------------------------------------------

DEFAULT = (
    "{% for m in messages %}"
    "{% if loop.first %}<s>{% endif %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}<<SYS>>{{ m.text | escape }}<</SYS>>"
    "{% else %}[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}</s>{% endif %}"
    "{% endfor %}"
)


class Reader:
    """Reads turns back from formatted text that arrives in pieces; holds one turn at most."""

    NEXT = re.compile(r"\[INST\] (.*?) \[/INST\]|<<SYS>>(.*?)<</SYS>>|\[ROLE\](.*?)\[/ROLE\](.*?)</s>|(.*?)</s>", re.S)
    END = ("[/INST]", "</s>", "<</SYS>>")

    def __init__(self):
        self.held, self.begun = [], False

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.held.append(text)
        if not text.endswith(self.END):
            return
        text = "".join(self.held)
        if not self.begun:
            text, self.begun = text.removeprefix("<s>"), True
        at = 0
        while m := self.NEXT.match(text, at):
            user, system, role, other, assistant = m.groups()
            at = m.end()
            if user is not None:
                yield "user", unescape(user)
            elif system is not None:
                yield "system", unescape(system)
            elif role is not None:
                yield unescape(role), unescape(other)
            else:
                yield "assistant", unescape(assistant)
        self.held = [text[at:]]


class _Digest:
    """What is reported of one conversation, updated piece by piece."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n, self.loss_chars, self.chars, self.reader = 0, 0, 0, Reader()

    def add(self, text: str, masked: bool) -> None:
        self.chars += len(text)
        if masked:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        for role, body in self.reader.feed(text):
            self.n += 1
            self.turns.update(f"{role}\n{body}\n".encode())


def format_digests(conversations: DataFrame, source: str = DEFAULT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation.

    Turns are taken by turn, then role and text; a null role or text is an empty one; a null conv_id is a conversation
    of its own; ids may be of any type that can be sorted. One exchange by conversation and a sort that spills; a task holds one turn at a time.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def task(batches):
        template, ids = compile_template(source), None

        def turns():
            nonlocal ids
            for batch in batches:
                ids = batch.schema.field(0).type
                yield from zip(*(c.to_pylist() for c in batch.columns))

        stream = turns()
        ahead, done = next(stream, _END), []
        while ahead is not _END:
            conv = ahead[0]

            def messages(conv=conv):
                nonlocal ahead
                while ahead is not _END and _same(ahead[0], conv):
                    message = {"role": ahead[1], "text": ahead[2]}
                    ahead = next(stream, _END)
                    yield message

            d = _Digest()
            for text, masked in template({"messages": messages()}):
                d.add(text, masked)
            while ahead is not _END and _same(ahead[0], conv):  # a template need not read all
                ahead = next(stream, _END)
            done.append((conv, d.n, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars))
            if len(done) == 5_000:
                yield _batch(done, ids, names)
                done = []
        if done:
            yield _batch(done, ids, names)

    return rows.mapInArrow(task, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _same(a, b) -> bool:
    """Equal ids; not-a-number equals itself, as in Spark's exchange and sort."""
    return a == b or (a != a and b != b)


def _batch(rows: list[tuple], ids: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
