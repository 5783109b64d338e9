"""Branching patterns in one pass: all branches of an expression are matched together on streams of nodes in document order, with a stack of open nodes.

A pattern is a tree: the steps of a path and, hanging on them, the paths in its predicates. Nodes that can match any part of it are shuffled once, by document and range of
numbers ("bucket"), and sorted. Going through a bucket, what a node's branches need is known when it closes: bits say which parts have matched below it, and results
wait with the open node that they hang on. A node that goes on behind its bucket lies in each bucket that it touches; what these find for it is put together, a few rows a
document, before the results that hang on it are let through. A table whose documents lie in one bucket each needs none of that.
"""

from __future__ import annotations

import itertools
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import xpath as X
from .summary import _named, shapes
from .xpath import Binary, Call, Literal, Number, Path, Step, XPathError

#: Numbers of a bucket.
WIDTH = 1 << 16
#: Names of nodes that a task remembers the parts for at once.
NAMES = 10_000
_FIELDS = ("doc_id", "pre", "post", "parent", "level", "kind", "prefix", "name", "value", "path")
_OUT = "doc_id bigint, pre int, post int, parent int, level int, kind string, prefix string, name string, value string, path string"
_COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_FLIP = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_NUMBER = re.compile(r"[ \t\r\n]*(-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))[ \t\r\n]*")


@dataclass(frozen=True)
class Part:
    """A node of a pattern. ``needs``: a formula over parts below: ("has", part), ("and" | "or", x, y), ("not", x), or None. ``value``: how its string value has to compare."""

    step: Step
    needs: object = None
    value: tuple[str, object] | None = None
    main: int = -1  # its place on the path, from 0

    @property
    def deep(self) -> bool:
        return self.step.axis == "descendant"


@dataclass
class Pattern:
    """Parts; those of the path are ``main``, of which the first is anchored by the form of its path."""

    parts: list[Part] = field(default_factory=list)
    main: list[int] = field(default_factory=list)
    anchor: str = ""

    def add(self, part: Part) -> int:
        self.parts.append(part)
        return len(self.parts) - 1

    def formula(self, e: object) -> object:
        if isinstance(e, Binary) and e.op in ("and", "or"):
            return e.op, self.formula(e.left), self.formula(e.right)
        if isinstance(e, Call) and e.name in ("not", "boolean") and isinstance(e.args[0], (Binary, Call, Path)):
            inner = self.formula(e.args[0])
            return ("not", inner) if e.name == "not" else inner
        if isinstance(e, Path):
            return self.chain(e, None)
        if isinstance(e, Binary) and e.op in _COMPARE:
            left, right, op = e.left, e.right, e.op
            if isinstance(right, Path):
                left, right, op = right, left, _FLIP[op]
            if isinstance(left, Path) and isinstance(right, (Literal, Number)):
                return self.chain(left, (op, right.value if isinstance(right, Literal) else float(right.value)))
        raise XPathError("no pattern of branches")

    def chain(self, p: Path, value: tuple[str, object] | None) -> object:
        if p.absolute or p.start is not None:
            raise XPathError("no pattern of branches")
        below: object = None
        for s in reversed(p.steps):
            _simple(s)
            needs = self.all_of(s.predicates, below)
            below = ("has", self.add(Part(s, needs, value)))
            value = None
        return below

    def all_of(self, predicates: tuple, more: object = None) -> object:
        for q in predicates:
            f = self.formula(q)
            more = f if more is None else ("and", f, more)
        return more


def _simple(s: Step) -> None:
    if s.axis not in ("child", "descendant", "attribute") or s.test.endswith("()") and s.test != "text()" or s.test.startswith("processing") or any(X.positional(q) for q in s.predicates):
        raise XPathError("no pattern of branches")


def compiled(xpath: str) -> Pattern:
    """The pattern of an absolute path of child, descendant and attribute steps whose predicates are such paths, compared with constants or not, under and, or and not."""
    e = X.parse(xpath)
    if not isinstance(e, Path) or not e.absolute or e.start is not None:
        raise XPathError("no pattern of branches")
    pattern = Pattern()
    first = next((i for i, s in enumerate(e.steps) if s.predicates), len(e.steps) - 1)
    shape = ""
    for i, s in enumerate(e.steps):
        _simple(s)
        if i <= first:
            shape = _named(s, shape + ("(/[^/]+)*" if s.axis == "descendant" else ""))[1]
        if i >= first:
            pattern.main.append(pattern.add(Part(s, pattern.all_of(s.predicates), None, i - first)))
    pattern.anchor = shape
    return pattern


def _fits(step: Step) -> Callable[[dict], bool]:
    name = step.test
    if name == "text()":
        return lambda n: n["kind"] in ("text", "cdata")
    kind = "attribute" if step.axis == "attribute" else "element"
    prefix, _, local = name.rpartition(":")
    return lambda n: n["kind"] == kind and (local == "*" or n["name"] == local) and (n["prefix"] == prefix if prefix else local == "*" or n["prefix"] is None)


def _number(text: str) -> float:
    m = _NUMBER.fullmatch(text)
    return float(m[1]) if m else float("nan")


@dataclass(slots=True, eq=False)
class _Open:
    node: dict
    end: int
    fits: list[int]
    bits: int
    up: int = 0
    texts: list[str] = field(default_factory=list)
    hangs: dict[int, set] = field(default_factory=dict)  # results below, by the step of the path that they still need in front of them
    far: dict[int, set] = field(default_factory=dict)  # those that open nodes further up get as well


class Machine:
    """Goes through one bucket's nodes in document order."""

    def __init__(self, pattern: Pattern, every: bool = False):
        """``every``: what is asked for are all nodes that are good as some step of the path, not only as the last."""
        self.pattern, self.every = pattern, every
        self.tests = [_fits(p.step) for p in pattern.parts]
        self.anchor = re.compile(f"{pattern.anchor}\\Z")
        self.valued = any(p.value is not None for p in pattern.parts)
        self.known: dict[tuple, list[int]] = {}  # parts that nodes of a kind and name fit, of the last names met
        self.start(0, 1 << 62)

    def start(self, first: int, last: int) -> None:
        self.first, self.last = first, last
        self.stack: list[_Open] = []
        self.good: set = set()
        self.rows: dict[int, dict] = {}
        self.spread: list[_Open] = []

    def _holds(self, f: object, bits: int) -> bool:
        if f is None:
            return True
        op = f[0]
        if op == "has":
            return bool(bits >> f[1] & 1)
        if op == "not":
            return not self._holds(f[1], bits)
        return self._holds(f[1], bits) and self._holds(f[2], bits) if op == "and" else self._holds(f[1], bits) or self._holds(f[2], bits)

    def _compares(self, o: _Open, value: tuple[str, object]) -> bool:
        op, other = value
        own = "".join(o.texts) if o.node["kind"] == "element" else o.node["value"] or ""
        if isinstance(other, str) and op in ("=", "!="):
            return _COMPARE[op](own, other)
        a, b = _number(own), other if isinstance(other, float) else _number(other)
        return op == "!=" if a != a or b != b else _COMPARE[op](a, b)

    def see(self, node: dict, end: int, bits: int = 0, texts: list[str] | None = None) -> None:
        """The next node; ``end``: the greatest number in it."""
        while self.stack and self.stack[-1].end < node["pre"]:
            self._close(self.stack.pop())
        if self.valued and node["kind"] in ("text", "cdata") and node["pre"] >= self.first:
            for o in self.stack:
                o.texts.append(node["value"] or "")
        named = node["kind"], node["prefix"], node["name"]
        fits = self.known.get(named)
        if fits is None:
            if len(self.known) == NAMES:
                self.known.clear()
            fits = self.known[named] = [i for i, t in enumerate(self.tests) if t(node)]
        if fits:
            self.stack.append(_Open(node, end, fits, bits, 0, texts or []))

    def finish(self) -> None:
        while self.stack:
            self._close(self.stack.pop())

    def _close(self, o: _Open) -> None:
        above = self.stack[-1] if self.stack else None
        if o.node["pre"] < self.first or o.end > self.last:  # others know more about it
            self.spread.append(o)
        else:
            self._judge(o, above)
        if above is not None:
            above.up |= o.up
            above.bits |= o.up
            for step, mine in o.far.items():
                above.hangs.setdefault(step, set()).update(mine)
                above.far.setdefault(step, set()).update(mine)

    def _judge(self, o: _Open, above: _Open | None) -> None:
        parent = above if above is not None and above.node["pre"] == o.node["parent"] else None
        for i in o.fits:
            p = self.pattern.parts[i]
            if not self._holds(p.needs, o.bits) or p.value is not None and not self._compares(o, p.value):
                continue
            if p.main < 0:
                if p.deep:
                    o.up |= 1 << i
                elif parent is not None:
                    parent.bits |= 1 << i
                continue
            last = p.main == len(self.pattern.main) - 1
            results = set(o.hangs.get(p.main + 1, ())) if not last else set()
            if last or self.every:
                results.add((o.node["pre"], p.main))
                self.rows[o.node["pre"]] = o.node
            if not results:
                continue
            if p.main == 0:
                if self.anchor.match(o.node["path"]):
                    self.good |= results
            elif p.deep:
                o.far.setdefault(p.main, set()).update(results)
            elif parent is not None:
                parent.hangs.setdefault(p.main, set()).update(results)


_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * 5]
_ROWS = pa.schema(list(zip(_FIELDS, _TYPES, strict=True)))
#: What a bucket gives besides results: nodes that go beyond it, with what was found for them; and results that hang on those, by ``on`` and ``step``.
_FOUND = pa.schema([*_ROWS, ("what", pa.string()), ("bucket", pa.int64()), ("bits", pa.string()), ("texts", pa.string()), ("on", pa.int32()), ("step", pa.int32())])


def _batches(rows: Iterator[tuple], like: pa.Schema, most: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], f.type) for i, f in enumerate(like)], schema=like)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], f.type) for i, f in enumerate(like)], schema=like)


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with the same key; each has to be used up before the next."""
    rows = (r for b in batches for at in range(0, b.num_rows, 2048) for r in b.slice(at, 2048).to_pylist())
    return itertools.groupby(rows, lambda r: tuple(r[k] for k in key))


def _scan(pattern: Pattern, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    machine = Machine(pattern)
    steps = len(pattern.main)
    for (_, bucket), rows in _groups(batches, ("doc_id", "bucket")):
        machine.start(bucket * width, bucket * width + width - 1)
        for r in rows:
            machine.see(r, r["post"] + r["level"])
        machine.finish()
        made = lambda n, *more: (*(n[f] for f in _FIELDS), *more)
        for pre, _ in machine.good:
            yield made(machine.rows[pre], "result", bucket, None, None, None, None)
        for o in machine.spread:
            yield made(o.node, "open", bucket, str(o.bits), "".join(o.texts), None, None)
            for step in range(1, steps):
                for pre, _ in o.hangs.get(step, ()):
                    yield made(machine.rows[pre], "hanging", bucket, None, None, o.node["pre"], step - 1)


def _spine(pattern: Pattern, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each document's nodes in several buckets, those that are good as a step of the path."""
    machine = Machine(pattern, every=True)
    for _, rows in _groups(batches, ("doc_id",)):
        machine.start(0, 1 << 62)
        held: dict | None = None
        bits, texts = 0, []

        def push(node: dict | None) -> None:
            if node is not None:
                machine.see(node, node["post"] + node["level"], bits, list(texts))

        for r in rows:
            if held is None or r["pre"] != held["pre"]:
                push(held)
                held, bits, texts = r, 0, []
            bits |= int(r["bits"])
            texts.append(r["texts"])
        push(held)
        machine.finish()
        for pre, step in machine.good:
            yield (*(machine.rows[pre][f] for f in _FIELDS), "good", None, None, None, pre, step)


def match(nodes: DataFrame, xpath: str, where: str | None = None, width: int = WIDTH, split: bool | None = None) -> DataFrame:
    """The nodes that an expression with a pattern gives, as rows of ``_OUT``; an XPathError for other expressions.

    ``split``: whether any document has over ``width`` nodes, which is looked up if it isn't said. If not, the plan has one shuffle; if so, what the buckets
    give is written to ``where``, a new folder that driver and executors share.
    """
    pattern = compiled(xpath)
    if split is None:
        split = (nodes.agg(F.max("pre").alias("n")).first().n or 0) >= width
    wanted = F.lit(False)
    for kind, shape in sorted(shapes(xpath)):
        wanted = wanted | (F.col("kind").rlike(f"^({kind})$") & F.col("path").rlike(f"^{shape}$"))
    rows = nodes.filter(wanted).select(*_FIELDS)
    buckets = F.expr(f"sequence(pre div {width}, (cast(post as long) + level) div {width})")  # a node's last number is its post and its level
    dealt = rows.withColumn("bucket", F.explode(buckets)) if split else rows.withColumn("bucket", F.lit(0).cast("long"))
    if not split:
        width = 1 << 40
    order = ["doc_id", "bucket", "pre"]
    sorted_ = dealt.repartition("doc_id", "bucket").sortWithinPartitions(*order)
    schema = f"{_OUT}, what string, bucket bigint, bits string, texts string, `on` int, step int"
    found = sorted_.mapInArrow(lambda b: _batches(_scan(pattern, width, b), _FOUND), schema)
    fields = list(_FIELDS)
    if not split:
        return found.select(*fields)
    if where is None:
        raise ValueError("documents of several buckets need a folder")
    found.write.parquet(where)
    found = nodes.sparkSession.read.schema(schema).parquet(where)
    spine = found.filter("what = 'open'").repartition("doc_id").sortWithinPartitions("doc_id", "pre", "bucket").mapInArrow(lambda b: _batches(_spine(pattern, b), _FOUND), schema)
    steps = len(pattern.main)
    let = found.filter("what = 'hanging'").join(spine.select("doc_id", "on", "step"), ["doc_id", "on", "step"], "left_semi")
    whole = spine.filter(F.col("step") == steps - 1)
    return found.filter("what = 'result'").select(*fields).unionByName(let.select(*fields)).unionByName(whole.select(*fields)).dropDuplicates(["doc_id", "pre"])
