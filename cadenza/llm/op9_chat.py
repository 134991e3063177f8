"""Chat formatting: a template compiler.

A template (text, ``{{ expression }}``, ``{% for x in y %}`` with ``loop``, ``{% if %}`` / ``elif`` / ``else``,
``{% set x = e %}``, ``{% generation %}``; ``{%-`` and ``-%}`` strip white space) is parsed into a syntax tree,
constants are folded, and the tree becomes Python closures. Only names that are given, items and slices by
constants, the listed operators, tests and filters exist: a template can reach nothing else. Rendering
yields (chunk, is_generation) one by one. A template that goes through ``messages`` once, and takes
single ones by their place from the start before or after that, is rendered in bounded memory whatever the
conversation's length; one that looks at them in any other way (twice, from the end, their number) holds the
conversation in memory, which the compiler sees from the tree (Need).

Defined results: a null role or text is empty; a conversation's rows are taken by turn, then role,
then text (nulls first), so ties have one order; repeated rows are repeated turns; a null
conversation id is a conversation of its own, ids may be of any type; an empty table gives no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.llm.arrow import KINDS

#: Turns are marked by control strings; text inside them is escaped, and only generations are in the loss.
CHAT_TEMPLATE = "{% for m in messages %}{{ open }}{{ m.role | line }}\n{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}{{ close }}\n{% endfor %}"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


class TemplateError(ValueError):
    """A template that is not in the language, or a name that is not given."""


def escape(text: str) -> str:
    """Reversible: no control string can stand in the result."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    """escape(), and the result is one line."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable] = {"escape": escape, "line": escape_line, "trim": lambda x: x.strip(), "upper": lambda x: x.upper(), "lower": lambda x: x.lower(), "length": lambda x: len(x), "string": lambda x: str(x)}

#: Tests after "is"; all but "defined" look at a value that must be there.
TESTS: dict[str, Callable] = {"defined": lambda x: True, "none": lambda x: x is None, "string": lambda x: isinstance(x, str)}

# Syntax tree


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    parts: tuple = field(default=())


_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+<>|.:()\[\]~]))")
_ESCAPES = {"n": "\n", "t": "\t"}


def _lex(source: str) -> list[tuple[str, object]]:
    found, at = [], 0
    while at < len(source.rstrip()):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"not an expression: {source!r}")
        at = m.end()
        kind, raw = m.lastgroup, m[m.lastgroup]
        found.append((kind, re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), raw[1:-1], flags=re.S) if kind == "text" else int(raw) if kind == "number" else raw))
    return found


class _Expression:
    """Recursive descent: or, and, not, comparison, sum, filters, item access."""

    def __init__(self, source: str):
        self.tokens, self.at, self.source = _lex(source), 0, source

    def peek(self) -> tuple[str, object]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *values: object) -> object:
        kind, value = self.peek()
        if kind in ("sign", "name") and value in values:
            self.at += 1
            return value
        return None

    def parse(self) -> Node:
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"not an expression: {self.source!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", None, (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", None, (node, self.negated()))
        return node

    def negated(self) -> Node:
        return Node("not", None, (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.summed()
        while True:
            if sign := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
                node = Node("compare", sign, (node, self.summed()))
            elif self.take("not"):
                if not self.take("in"):
                    raise TemplateError(f"not an expression: {self.source!r}")
                node = Node("not", None, (Node("compare", "in", (node, self.summed())),))
            elif self.take("is"):
                negated, (_, name) = self.take("not"), self.peek()
                if name not in TESTS:
                    raise TemplateError(f"no such test: {name!r}")
                self.at += 1
                node = Node("test", name, (node,))
                node = Node("not", None, (node,)) if negated else node
            else:
                return node

    def summed(self) -> Node:
        node = self.filtered()
        while sign := self.take("+", "-", "~"):
            node = Node("sum", sign, (node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.item()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no such filter: {name!r}")
            self.at += 1
            node = Node("filter", name, (node,))
        return node

    def item(self) -> Node:
        kind, value = self.peek()
        self.at += 1
        if kind in ("text", "number"):
            node = Node("constant", value)
        elif kind == "name":
            node = Node("constant", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Node("name", value)
        elif value == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError(f"not closed: {self.source!r}")
        else:
            raise TemplateError(f"not an expression: {self.source!r}")
        while sign := self.take(".", "["):
            if sign == ".":
                kind, value = self.peek()
                self.at += 1
                if kind != "name":
                    raise TemplateError(f"items are accessed by constants: {self.source!r}")
                node = Node("item", value, (node,))
                continue
            start = self.key()
            if self.take(":"):
                node = Node("slice", (start, self.key()), (node,))
            elif start is None:
                raise TemplateError(f"items are accessed by constants: {self.source!r}")
            else:
                node = Node("item", start, (node,))
            if not self.take("]"):
                raise TemplateError(f"items are accessed by constants: {self.source!r}")
        return node

    def key(self) -> object:
        """A text or whole number, or None where there is none."""
        negative, (kind, value) = self.take("-"), self.peek()
        if kind == "number" or kind == "text" and not negative:
            self.at += 1
            return -value if negative else value
        if negative:
            raise TemplateError(f"items are accessed by constants: {self.source!r}")
        return None


#: A tag: an expression, a statement or a comment; a hyphen inside its signs strips the white space beyond them.
_TAG = re.compile(r"\{\{(?P<lshow>-?)(?P<show>.*?)(?P<rshow>-?)\}\}|\{%(?P<ldo>-?)(?P<do>.*?)(?P<rdo>-?)%\}|\{#(?P<lnote>-?).*?(?P<rnote>-?)#\}", re.S)


def parse(template: str) -> Node:
    """The syntax tree of a template."""
    stack: list[tuple[str, object, list[Node]]] = [("root", None, [])]
    at, stripped = 0, False
    for m in _TAG.finditer(template):
        text = template[at : m.start()]
        text = text.lstrip() if stripped else text
        text = text.rstrip() if m["lshow"] or m["ldo"] or m["lnote"] else text
        if text:
            stack[-1][2].append(Node("text", text))
        at, stripped = m.end(), bool(m["rshow"] or m["rdo"] or m["rnote"])
        if m["show"] is not None:
            stack[-1][2].append(Node("show", None, (_Expression(m["show"]).parse(),)))
        elif m["do"] is not None:
            word, rest = (m["do"].split(None, 1) + ["", ""])[:2]
            rest = rest.strip()
            if word == "for" and (f := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                stack.append(("for", (f[1], _Expression(f[2]).parse()), []))
            elif word == "set" and (f := re.fullmatch(r"([A-Za-z_]\w*)\s*=(.+)", rest, re.S)):
                stack[-1][2].append(Node("set", f[1], (_Expression(f[2]).parse(),)))
            elif word == "if":
                stack.append(("if", [_Expression(rest).parse()], []))
                stack.append(("branch", None, []))
            elif word in ("elif", "else") and stack[-1][0] == "branch" and len(stack[-2][1]) > len(stack[-2][2]):
                stack[-2][2].append(Node("block", None, tuple(stack.pop()[2])))
                if word == "elif":
                    stack[-1][1].append(_Expression(rest).parse())
                stack.append(("branch", None, []))
            elif word == "endif" and stack[-1][0] == "branch":
                block = Node("block", None, tuple(stack.pop()[2]))
                _, tests, blocks = stack.pop()
                stack[-1][2].append(Node("if", None, (tuple(tests), (*blocks, block))))
            elif word == "endfor" and stack[-1][0] == "for":
                _, (name, over), body = stack.pop()
                stack[-1][2].append(Node("for", name, (over, Node("block", None, tuple(body)))))
            elif word == "generation":
                stack.append(("generation", None, []))
            elif word == "endgeneration" and stack[-1][0] == "generation":
                body = stack.pop()[2]
                stack[-1][2].append(Node("generation", None, (Node("block", None, tuple(body)),)))
            else:
                raise TemplateError(f"not a statement here: {m['do']!r}")
    if tail := template[at:].lstrip() if stripped else template[at:]:
        stack[-1][2].append(Node("text", tail))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return Node("block", None, tuple(stack[0][2]))


_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}
_SUM = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: f"{a}{b}"}


def fold(node: Node, known: dict) -> Node:
    """The tree with what is constant computed: operators on constants, known names, decided ifs, adjacent texts."""
    if node.kind == "name":
        return Node("constant", known[node.value]) if node.value in known else node
    if node.kind == "block":
        parts: list[Node] = []
        for part in node.parts:
            part = fold(part, known)
            for p in part.parts if part.kind == "block" else (part,):
                if p.kind == "text" and parts and parts[-1].kind == "text":
                    parts[-1] = Node("text", parts[-1].value + p.value)
                else:
                    parts.append(p)
        return Node("block", None, tuple(parts))
    if node.kind == "if":
        tests, blocks = node.parts
        tests, kept, bodies = [fold(t, known) for t in tests], [], []
        blocks = [fold(b, known) for b in blocks] + [Node("block")] * (len(blocks) == len(tests))
        for test, body in zip([*tests, Node("constant", True)], blocks):
            if test.kind == "constant" and not test.value:
                continue
            kept.append(test)
            bodies.append(body)
            if test.kind == "constant":
                break
        return bodies[0] if kept and kept[0].kind == "constant" else Node("if", None, (tuple(kept[:-1]), tuple(bodies)))
    if node.kind == "for":
        inner = {k: v for k, v in known.items() if k not in _bound(node)}
        return Node("for", node.value, (fold(node.parts[0], known), fold(node.parts[1], inner)))
    parts = tuple(fold(p, known) for p in node.parts)
    node = Node(node.kind, node.value, parts)
    if parts and all(p.kind == "constant" for p in parts) and node.kind in ("and", "or", "not", "compare", "sum", "filter", "test"):
        try:
            return Node("constant", _value(node)({}))
        except (TypeError, ValueError, AttributeError):
            return node  # wrong only if it is reached
    if node.kind == "show" and parts[0].kind == "constant":
        return Node("text", str(parts[0].value))
    return node


def _bound(node: Node) -> set[str]:
    """Names that a loop gives a value."""
    names = {node.value} if node.kind in ("for", "set") else set()
    names |= {"loop"} if node.kind == "for" else set()
    for part in node.parts:
        for p in part if isinstance(part, tuple) else (part,):
            names |= _bound(p)
    return names


def _value(node: Node) -> Callable[[dict], object]:
    """An expression as a closure."""
    kind, value = node.kind, node.value
    if kind == "constant":
        return lambda names: value
    if kind == "name":

        def name(names: dict) -> object:
            if value not in names:
                raise TemplateError(f"no such name: {value}")
            return names[value]

        return name
    parts = [_value(p) for p in node.parts]
    first = parts[0]
    if kind == "item":

        def item(names: dict) -> object:
            held = first(names)
            if not isinstance(held, dict | list | tuple | Messages):
                raise TemplateError(f"no items in {type(held).__name__}")
            return held.get(value, "") if isinstance(held, dict) else held[value]

        return item
    if kind == "slice":
        return lambda names: first(names)[slice(*value)]
    if kind == "test":
        test, what = TESTS[value], node.parts[0]
        if value == "defined" and what.kind == "name":
            return lambda names: what.value in names
        if value == "defined" and what.kind == "item":
            above = _value(what.parts[0])
            return lambda names: what.value in held if isinstance(held := above(names), dict) else bool(held[what.value : what.value + 1])
        return lambda names: test(first(names))
    if kind == "filter":
        apply = FILTERS[value]
        return lambda names: apply(first(names))
    if kind == "not":
        return lambda names: not first(names)
    second = parts[1]
    if kind == "and":
        return lambda names: first(names) and second(names)
    if kind == "or":
        return lambda names: first(names) or second(names)
    apply = (_COMPARE if kind == "compare" else _SUM)[value]
    return lambda names: apply(first(names), second(names))


Chunks = Iterator[tuple[str, bool]]
_END = object()


@dataclass(frozen=True)
class Need:
    """What a template wants of messages beside one pass in order: the first so many of them, or all at any time."""

    first: int = 0
    all: bool = False


def needs(node: Node, name: str = "messages") -> Need:
    """Of a syntax tree."""
    passes, first, whole = 0, 0, False

    def walk(node: Node, within: bool) -> None:
        nonlocal passes, first, whole
        if node.kind == "name" and node.value == name:
            whole = True  # in an expression of any other form
        if node.kind in ("item", "test") and node.parts[0] == Node("name", name):
            if node.kind == "item" and isinstance(node.value, int) and node.value >= 0:
                first = max(first, node.value + 1)
                return
            if node.kind == "test":
                return
        if node.kind == "for":
            if node.parts[0] == Node("name", name):
                passes += 2 if within else 1
            else:
                walk(node.parts[0], within)
            walk(node.parts[1], True)
            return
        for part in node.parts:
            for p in part if isinstance(part, tuple) else (part,):
                walk(p, within)

    walk(node, False)
    return Need(first, whole or passes > 1)


class Messages:
    """A conversation's messages as a template sees them: read from a stream as far as asked, and kept as far as needed."""

    def __init__(self, rows: Iterable[dict], need: Need):
        self.rows, self.need = iter(rows), need
        self.held = list(self.rows) if need.all else []

    def _fill(self, n: int) -> None:
        while len(self.held) < n and (row := next(self.rows, None)) is not None:
            self.held.append(row)

    def __iter__(self) -> Iterator[dict]:
        self._fill(self.need.first)
        yield from self.held
        yield from self.rows

    def __getitem__(self, at: int | slice) -> dict | list[dict]:
        self._fill(self.need.first)
        return self.held[at]

    def __len__(self) -> int:
        return len(self.held)


def _render(node: Node, marked: bool) -> Callable[[dict], Chunks]:
    """A statement as a closure that yields (text, is in a generation)."""
    kind, value = node.kind, node.value
    if kind == "text":
        return lambda names: iter(((value, marked),))
    if kind == "show":
        shown = _value(node.parts[0])
        return lambda names: iter(((str(shown(names)), marked),))
    if kind == "set":
        given = _value(node.parts[0])

        def assign(names: dict) -> Chunks:
            names[value] = given(names)
            return iter(())

        return assign
    if kind == "generation":
        return _render(node.parts[0], True)
    if kind == "block":
        steps = [_render(p, marked) for p in node.parts]

        def block(names: dict) -> Chunks:
            for step in steps:
                yield from step(names)

        return block
    if kind == "for":
        over, body = _value(node.parts[0]), _render(node.parts[1], marked)

        def loop(names: dict) -> Chunks:
            inner, held = dict(names), over(names)
            items, index = iter(held), 0
            item = next(items, _END)
            while item is not _END:
                after = next(items, _END)
                index += 1
                inner[value], inner["loop"] = item, {"index": index, "index0": index - 1, "first": index == 1, "last": after is _END}
                yield from body(inner)
                item = after

        return loop
    tests, bodies = [_value(t) for t in node.parts[0]], [_render(b, marked) for b in node.parts[1]]

    def choose(names: dict) -> Chunks:
        for test, body in zip(tests, bodies):
            if test(names):
                yield from body(names)
                return
        yield from bodies[len(tests)](names)

    return choose


@lru_cache(maxsize=32)
def compile_template(template: str, constants: tuple[tuple[str, object], ...] = ()) -> Callable[[dict], Chunks]:
    """names -> (text, is in a generation) chunks; constants are folded into the program."""
    tree = fold(parse(template), dict(constants))
    rendered, need = _render(tree, False), needs(tree)

    def program(names: dict) -> Chunks:
        return rendered(names | {"messages": Messages(names["messages"], need)} if "messages" in names else dict(names))

    return program


def chat_program(template: str = CHAT_TEMPLATE) -> Callable[[dict], Chunks]:
    return compile_template(template, (("open", OPEN), ("close", CLOSE)))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a conversation formatted by CHAT_TEMPLATE."""
    turns = []
    for part in formatted.split(OPEN)[1:]:
        role, _, text = part.removesuffix("\n").removesuffix(CLOSE).partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


class Reader:
    """Reads formatted chunks of one conversation as they come and keeps digests only."""

    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars, self.buffer = 0, 0, 0, []
        self.turn_digest, self.loss_digest = sha256(), sha256()

    def feed(self, chunk: str, marked: bool) -> None:
        self.chars += len(chunk)
        self.buffer.append(chunk)
        if marked:
            text = unescape(chunk)
            self.loss_chars += len(text)
            self.loss_digest.update(text.encode("utf-8", "surrogatepass"))
        elif chunk.endswith(CLOSE + "\n"):
            self.flush()

    def flush(self) -> None:
        for role, text in read_back("".join(self.buffer)):
            self.turns += 1
            self.turn_digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.buffer = []


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterable[dict]]]:
    """(id, its messages) from rows sorted by id; the messages must be read before the next id is asked for."""
    rows = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(*(b.column(n).to_pylist() for n in ("conv_id", "role", "text"))))
    ahead = next(rows, None)

    def messages(of: object) -> Iterator[dict]:
        nonlocal ahead
        # a number that isn't one equals itself here
        while ahead is not None and (ahead[0] == of or repr(ahead[0]) == repr(of)):
            yield ahead[1]
            ahead = next(rows, None)

    while ahead is not None:
        of = ahead[0]
        rest = messages(of)
        yield of, rest
        for _ in rest:  # what the template didn't read
            pass


def _streamed(conversations: DataFrame, made: dict[str, str], run: Callable[[object, Iterable[dict]], Iterator[tuple]], held_rows: int) -> DataFrame:
    """conv_id and the columns in made, of the tuples that run yields for each conversation, which it reads in order."""
    rows = _ordered(conversations)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds = [first.schema.field("conv_id").type, *[KINDS[k] for k in made.values()]]
        batch_of = lambda held: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names=["conv_id", *made])
        held = []
        for of, messages in _conversations(chain([first], batches)):
            for found in run(of, messages):
                held.append((of, *found))
                if len(held) == held_rows:
                    yield batch_of(held)
                    held = []
        if held:
            yield batch_of(held)

    fields = StructType.fromDDL(", ".join(f"{n} {k}" for n, k in made.items())).fields
    return rows.mapInArrow(apply, StructType([rows.schema["conv_id"], *fields]))


def format_conversations(conversations: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """conv_id, position, chunk, is_generation: the formatted text in pieces that join in order of position."""

    def run(of: object, messages: Iterable[dict]) -> Iterator[tuple]:
        for position, (chunk, marked) in enumerate(chat_program(template)({"messages": messages})):
            yield position, chunk, marked

    return _streamed(conversations, {"position": "long", "chunk": "string", "is_generation": "boolean"}, run, 10_000)


def digest_conversations(conversations: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """One row for each conversation, read back from its formatted text: turns, loss mask and lengths.

    A conversation is streamed through in order: only hash states and one turn are in memory.
    """

    def run(of: object, messages: Iterable[dict]) -> Iterator[tuple]:
        reader = Reader()
        for chunk, marked in chat_program(template)({"messages": messages}):
            reader.feed(chunk, marked)
        reader.flush()
        yield reader.turns, reader.turn_digest.hexdigest(), reader.loss_chars, reader.loss_digest.hexdigest(), reader.chars

    return _streamed(conversations, {"n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long"}, run, 5000)
