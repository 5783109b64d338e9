"""Tables of nodes stored by path, and expressions over them that read only the paths they can need.

A store has a summary: the distinct paths of its nodes, numbered in their order, so that the paths below one have numbers in a row. Nodes lie in files by these
numbers. The axis steps of an expression are matched on the summary, which says what ranges of numbers its parts can meet; they become a filter on the scan, and Parquet's
statistics leave out the files and row groups of all other paths.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbering import gapless
from ..model import FIELDS
from ..sources.readers import unbroadcast
from . import xpath as X
from .xpath import Binary, Call, Filter, Negative, Path, Step
from .xpath_frames import Frames, string_values

#: Ranges of numbers in a filter at most; nearest ranges are joined beyond that, and the exact paths are looked up in addition.
RANGES = 200
#: Summaries of up to so many paths are broadcast to the nodes that are being stored.
BROADCAST_PATHS = 100_000
_BELOW = "(/[^/]+)*"


def store(nodes: DataFrame, where: str, parts: int | None = None) -> None:
    """Writes a table of nodes to ``where``: ``nodes``, sorted by the number of their path, ``paths`` and ``docs``. ``where`` is a new folder that driver and executors share."""
    spark = nodes.sparkSession
    nodes.write.parquet(f"{where}/parsed")
    parsed = spark.read.schema(nodes.schema).parquet(f"{where}/parsed")
    kinds = parsed.groupBy("path", "kind").agg(F.count("*").alias("n"))
    numbered = gapless(kinds, "path_id", f"{where}/kinds", F.asc("path"), F.asc("kind"), parts=parts).select(F.col("path_id").cast("int").alias("path_id"), "path", "kind", "n")
    numbered.write.parquet(f"{where}/paths")
    paths = spark.read.parquet(f"{where}/paths")
    ids = paths.select("path_id", "path", "kind")
    known = parsed.join(F.broadcast(ids) if paths.count() <= BROADCAST_PATHS else ids, ["path", "kind"])
    order = ["path_id", "doc_id", "pre"]
    many = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known.select("path_id", *FIELDS).repartitionByRange(many, *order).sortWithinPartitions(*order).write.parquet(f"{where}/nodes")
    parsed.select("doc_id").distinct().write.parquet(f"{where}/docs")
    for name in ("parsed", "kinds"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _named(step: Step, shape: str) -> tuple[str, str]:
    """The kind and the shape (a regular expression of paths) of what a step's test lets through below nodes of ``shape``."""
    name = step.test
    if step.axis in ("attribute", "namespace"):
        local = "[^/]+" if name in ("*", "node()") else re.escape(name) if ":" not in name or not name.endswith("*") else re.escape(name[:-1]) + "[^/]+"
        return ("attribute", f"{shape}/@{local}") if step.axis == "attribute" else ("namespace", shape)
    if name == "text()":
        return "text|cdata", shape
    if name == "comment()":
        return "comment", shape
    if name.startswith("processing-instruction("):
        return "pi", shape
    if name == "node()":
        return ".*", f"{shape}(/[^/@][^/]*)?"
    local = "[^/@][^/]*" if name == "*" else re.escape(name[:-1]) + "[^/]+" if name.endswith(":*") else re.escape(name)
    return "element", f"{shape}/{local}"


class _Needs:
    """Kinds and shapes of the paths that evaluating an expression can touch."""

    def __init__(self):
        self.found: set[tuple[str, str]] = set()

    def need(self, kind: str, shape: str) -> None:
        self.found.add((kind, shape))

    def texts(self, shapes: list[tuple[str, str]]) -> None:
        """What string values of nodes need: texts in them, at any depth."""
        for _, s in shapes:
            self.need("text|cdata|entity", f"{s}{_BELOW}")

    def path(self, p: Path, context: list[tuple[str, str]]) -> list[tuple[str, str]]:
        now = self.nodes(p.start, context) if p.start is not None else [("document", "")] if p.absolute else context
        fast = Frames(None)._fast(p) if p.start is None and p.absolute else None
        unread = len(p.steps) - len(fast[1]) - 1 if fast else 0  # steps that a filter on paths does, but for the last of them
        for i, s in enumerate(p.steps):
            after: set[tuple[str, str]] = set()
            for kind, shape in now:
                if s.axis == "self":
                    after.add((kind, shape))
                elif s.axis in ("child", "attribute", "namespace"):
                    after.add(_named(s, shape))
                elif s.axis == "descendant":
                    after.add(_named(s, shape + _BELOW))
                elif s.axis == "descendant-or-self":
                    after |= {(kind, shape), _named(s, shape + _BELOW)}
                else:  # what such axes reach can be anywhere
                    after.add(_named(s, _BELOW))
            for a in after if i >= unread else ():
                self.need(*a)
            now = sorted(after)
            for q in s.predicates:
                self.value(q, now)
        return now

    def nodes(self, e: object, context: list[tuple[str, str]]) -> list[tuple[str, str]]:
        if isinstance(e, Path):
            return self.path(e, context)
        if isinstance(e, Binary) and e.op == "|":
            return sorted({*self.nodes(e.left, context), *self.nodes(e.right, context)})
        if isinstance(e, Filter):
            now = self.nodes(e.expr, context)
            for q in e.predicates:
                self.value(q, now)
            return now
        self.need(".*", ".*")
        return [(".*", _BELOW)]

    def value(self, e: object, context: list[tuple[str, str]], shown: bool = False) -> None:
        """``shown``: whether string values of nodes are looked at, not only whether there are any."""
        if Frames.is_nodes(e):
            found = self.nodes(e, context)
            if shown:
                self.texts(found)
        elif isinstance(e, Binary):
            logic = e.op in ("and", "or")
            self.value(e.left, context, not logic)
            self.value(e.right, context, not logic)
        elif isinstance(e, Negative):
            self.value(e.expr, context, True)
        elif isinstance(e, Call):
            if not e.args and e.name in ("string", "string-length", "normalize-space", "number"):
                self.texts(context)
            if e.name in ("id", "lang"):
                self.need(".*", ".*")
            for a in e.args:
                self.value(a, context, e.name not in ("not", "boolean", "count"))


def shapes(xpath: str, texts: bool = False) -> set[tuple[str, str]]:
    """Kinds and paths, both regular expressions, of all nodes that evaluating ``xpath`` can touch; with ``texts``, string values of its result too."""
    needs = _Needs()
    e = X.parse(xpath)
    if Frames.is_nodes(e):
        found = needs.nodes(e, [("document", "")])
        if texts:
            needs.texts(found)
    else:
        needs.value(e, [("document", "")], True)
    return needs.found


class _Pruned(Frames):
    """Over some of a store's nodes; ``docs`` has the ids of all its documents."""

    def __init__(self, nodes: DataFrame, docs: DataFrame):
        super().__init__(nodes)
        self.docs = docs

    def root(self) -> DataFrame:
        return self._rooted(self.docs)


class Store:
    """A table that ``store`` wrote."""

    def __init__(self, spark: SparkSession, where: str):
        self.nodes, self.paths, self.docs = (unbroadcast(spark.read.parquet(f"{where}/{t}")) for t in ("nodes", "paths", "docs"))

    def matching(self, xpath: str, texts: bool = False) -> DataFrame:
        """The rows of the summary that an expression's nodes can have."""
        hit = F.lit(False)
        for kind, shape in sorted(shapes(xpath, texts)):
            hit = hit | (F.col("kind").rlike(f"^({kind})$") & F.col("path").rlike(f"^{shape}$"))
        return self.paths.filter(hit)

    def pruned(self, xpath: str, texts: bool = False) -> DataFrame:
        """The nodes that evaluating an expression can touch, by a filter on numbers of paths that the scan gets."""
        ids = self.matching(xpath, texts).select("path_id")
        # numbers in a row as one range; of the ranges, the RANGES - 1 widest gaps stay
        step = ids.withColumn("gap", F.col("path_id") - F.lag("path_id").over(Window.orderBy("path_id")))
        cuts = [r.path_id for r in step.filter("gap > 1").orderBy(F.desc("gap"), "path_id").limit(RANGES).select("path_id", "gap").collect()]
        bounds = ids.agg(F.min("path_id").alias("a"), F.max("path_id").alias("b")).first()
        if bounds.a is None:
            return self.nodes.filter("false").select(*FIELDS)
        last = {r.path_id: r.path_id - r.gap for r in step.filter(F.col("path_id").isin(cuts)).collect()} if cuts else {}
        starts = [bounds.a, *sorted(cuts)]
        ends = [*(last[c] for c in sorted(cuts)), bounds.b]
        hit: Column = F.lit(False)
        for a, b in zip(starts, ends, strict=True):
            hit = hit | (F.col("path_id") == a if a == b else F.col("path_id").between(a, b))
        kept = self.nodes.filter(hit)
        if len(cuts) == RANGES:
            kept = kept.join(ids, "path_id", "left_semi")
        return kept.select(*FIELDS)

    def select(self, xpath: str) -> DataFrame:
        """The nodes that an expression gives, as ``xpath_frames.select``."""
        return _Pruned(self.pruned(xpath), self.docs).nodeset(X.parse(xpath), None).select(*FIELDS).dropDuplicates(["doc_id", "pre"])

    def string_values(self, xpath: str) -> DataFrame:
        """(doc_id, pre, text): the string values of the nodes that an expression gives."""
        nodes = self.pruned(xpath, True)
        found = _Pruned(nodes, self.docs).nodeset(X.parse(xpath), None).select(*FIELDS).dropDuplicates(["doc_id", "pre"])
        return string_values(found, nodes).select("doc_id", "pre", "text")

    def evaluate(self, xpath: str) -> DataFrame:
        """(doc_id, value) of an expression, once a document, as ``xpath_frames.evaluate``."""
        return _Pruned(self.pruned(xpath, True), self.docs).once(X.parse(xpath))
