"""XPath 1.0 over tables of nodes: expressions become filters, joins and aggregates that Catalyst plans.

Every join has doc_id among its keys, and those along axes of ranges blocks of numbers too (``containment``), so Spark hashes or sorts instead of looping and
one large document is many tasks' work. A path from the root by child steps is a filter on ``path``, and //name a filter on kind and name: no join at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import FIELDS
from . import containment
from . import xpath as X
from .xpath import REVERSE, Binary, Call, Filter, Literal, Negative, Number, Path, Step, XPathError

_OPS = {"=": "=", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
_MIRROR = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def number(text: Column) -> Column:
    """A string as a number, NaN where it is none."""
    t = F.trim(text)
    plain = F.regexp_like(t, F.lit(r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"))
    return F.when(plain, t.try_cast("double")).otherwise(F.lit(float("nan")))


def string(value: Column, kind: str) -> Column:
    if kind == "num":
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(F.isnan(value), "NaN").when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    return F.when(value, "true").otherwise("false") if kind == "bool" else F.coalesce(value, F.lit(""))


def size(prefix: str = "") -> Column:
    """Number of nodes below a node, from its numbers alone."""
    return F.col(f"{prefix}post").cast("long") - F.col(f"{prefix}pre") + F.col(f"{prefix}level")


def test(step: Step) -> Column:
    kind, name = F.col("kind"), step.test
    if name == "node()":
        main = {"attribute": kind == "attribute", "namespace": kind == "namespace"}.get(step.axis)
        return main if main is not None else ~kind.isin("attribute", "namespace") if step.axis not in ("self", "parent", "ancestor-or-self") else F.lit(True)
    if name == "text()":
        return kind.isin("text", "cdata")
    if name == "comment()":
        return kind == "comment"
    if name.startswith("processing-instruction("):
        wanted = name[23:-1].strip("'\"")
        return (kind == "pi") & (F.col("name") == wanted if wanted else F.lit(True))
    main = kind == {"attribute": "attribute", "namespace": "namespace"}.get(step.axis, "element")
    prefix, _, local = name.rpartition(":")
    if local != "*":
        main = main & (F.col("name") == local)
    if prefix:
        return main & (F.col("prefix") == prefix)
    return main if local == "*" else main & F.col("prefix").isNull()


#: Axes along which nodes are met by their numbers lying in a range.
_RANGES = ("descendant", "descendant-or-self", "ancestor", "ancestor-or-self", "following", "preceding")


def _join(axis: str) -> Column:
    """Between a context node (c_) and a node of the table, but for axes of _RANGES."""
    c, n = (lambda x: F.col(f"c_{x}")), F.col
    return {
        "child": n("parent") == c("pre"),
        "attribute": n("parent") == c("pre"),
        "namespace": n("parent") == c("pre"),
        "parent": n("pre") == c("parent"),
        "self": n("pre") == c("pre"),
        "following-sibling": (n("parent") == c("parent")) & (n("ord") > c("ord")),
        "preceding-sibling": (n("parent") == c("parent")) & (n("ord") < c("ord")),
    }[axis]


def string_values(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``text``: the string value of each target row, which has the columns of NODES."""
    texts = nodes.filter("kind in ('text', 'cdata')").select("doc_id", F.col("pre").alias("t_pre"), F.col("value").alias("t_value"))
    owners = targets.filter("kind in ('element', 'document')").select("doc_id", "pre", (F.col("pre") + size()).alias("_end"), "kind").distinct()
    below = containment.pairs(texts, F.col("t_pre"), owners.filter("kind = 'element'"), F.col("pre") + 1, F.col("_end"), ["doc_id"])
    whole = owners.filter("kind = 'document'").join(texts, "doc_id").select(below.columns)
    joined = below.unionByName(whole).groupBy("doc_id", "pre").agg(F.array_sort(F.collect_list(F.struct("t_pre", "t_value"))).alias("p"))
    found = joined.select("doc_id", "pre", F.array_join(F.transform("p", lambda x: x["t_value"]), "").alias("_text"))
    return targets.join(found, ["doc_id", "pre"], "left").withColumn("text", F.coalesce("_text", "value", F.lit(""))).drop("_text")


@dataclass
class _Typed:
    """A value for each context row: ``kind`` is num, str or bool."""

    column: Column
    kind: str

    def as_(self, kind: str) -> Column:
        if self.kind == kind:
            return self.column
        if kind == "str":
            return string(self.column, self.kind)
        if kind == "num":
            return self.column.cast("double") if self.kind == "bool" else number(self.column)
        return (self.column != 0) & ~F.isnan(self.column) if self.kind == "num" else F.length(self.column) > 0


class Frames:
    """Evaluates expressions over one table of nodes."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes
        self.made = 0

    def root(self) -> DataFrame:
        """A row for each document above its top-level nodes."""
        return self._rooted(self.nodes.select("doc_id").distinct())

    def _rooted(self, docs: DataFrame) -> DataFrame:
        values = {"pre": -1, "post": 2**31 - 1, "parent": -2, "level": -1, "ord": 0, "kind": "document", "prefix": None, "name": None, "ns_uri": None, "value": None, "path": ""}
        types = dict(self.nodes.dtypes)
        return docs.select("doc_id", *[F.lit(v).cast(types[k]).alias(k) for k, v in values.items()])

    def once(self, e: object) -> DataFrame:
        """(doc_id, value) of an expression, once a document."""
        rows = self.root()
        if self.is_nodes(e):
            rows, value = self._string(e, rows)
            return rows.select("doc_id", value.alias("value"))
        rows, v = self.value(e, rows)
        return rows.select("doc_id", v.column.alias("value"))

    # -- paths

    def _fast(self, path: Path) -> tuple[Column, tuple[Step, ...]] | None:
        """A filter that does the first steps of an absolute path, and the steps left."""
        steps = path.steps
        if not steps or not path.absolute:
            return None
        first = steps[0]
        if first.axis == "descendant" and not first.predicates and first.test != "node()":
            if len(steps) == 2 and steps[1].axis == "attribute" and not steps[1].predicates and "*" not in steps[1].test + first.test and "(" not in first.test:
                return test(steps[1]) & F.col("path").endswith(f"/{first.test}/@{steps[1].test}"), ()
            return test(first), steps[1:]
        n, names = 0, ""
        for s in steps:
            if s.axis != "child" or "(" in s.test or "*" in s.test or s.predicates:
                break
            n, names = n + 1, f"{names}/{s.test}"
        if not n:
            return None
        if n == len(steps) - 1 and steps[n].axis == "attribute" and not steps[n].predicates and "*" not in steps[n].test and "(" not in steps[n].test:
            return (F.col("kind") == "attribute") & (F.col("path") == f"{names}/@{steps[n].test}"), ()
        return (F.col("kind") == "element") & (F.col("path") == names), steps[n:]

    def select(self, path: Path, context: DataFrame | None = None) -> DataFrame:
        """Rows of the nodes that a path gives, with ``_o``: the pre of the context node (-1 without one)."""
        if path.start is not None:
            now = self.nodeset(path.start, context)
            steps = path.steps
        elif context is None or path.absolute:
            fast = self._fast(path)
            if fast is not None:
                now, steps = self.nodes.filter(fast[0]), fast[1]
            else:
                now, steps = self.root(), path.steps
            now = now.withColumn("_o", F.lit(-1))
            if context is not None:
                origins = context.select("doc_id", F.col("pre").alias("_o")).distinct()
                now = now.drop("_o").join(origins, "doc_id")
        else:
            now, steps = context.select(*FIELDS).withColumn("_o", F.col("pre")), path.steps
        for s in steps:
            now = self._step(now, s)
        return now

    def _ranged(self, now: DataFrame, s: Step) -> DataFrame:
        """Nodes that an axis of _RANGES gives, with ``_o`` and ``c_pre``."""
        pool = self.nodes.filter(test(s))
        inner, far = s.axis.startswith("descendant"), s.axis in ("following", "preceding")
        own = s.axis.endswith("-or-self")
        roots = now.filter("kind = 'document'")
        now = now.filter("kind != 'document'").withColumn("_end", F.col("pre") + size())
        if far and not s.predicates:  # of all contexts, that which has most behind or before it has all
            now = now.groupBy("doc_id", "_o").agg(*([F.min("_end").alias("_end"), F.lit(-9).alias("pre"), F.lit(0).alias("post")] if s.axis == "following" else [F.max_by("post", "pre").alias("post"), F.max("pre").alias("pre"), F.lit(0).alias("_end")]))
        context = now.select("doc_id", "_o", F.col("pre").alias("c_pre"), F.col("_end").alias("c_end"), F.col("post").alias("c_post") if far else F.lit(0).alias("c_post"))
        if inner:
            found = containment.pairs(pool, F.col("pre"), context, F.col("c_pre") + (0 if own else 1), F.col("c_end"), ["doc_id"])
            below = pool.join(roots.select("doc_id", "_o", F.col("pre").alias("c_pre")), "doc_id")
            if own and s.test == "node()":
                below = below.unionByName(roots.select(*FIELDS, "_o", F.col("pre").alias("c_pre")))
            return found.select(*FIELDS, "_o", "c_pre").unionByName(below.select(*FIELDS, "_o", "c_pre"))
        if s.axis == "following":
            ends = self.nodes.groupBy("doc_id").agg(F.max("pre").alias("c_last"))
            return containment.pairs(pool, F.col("pre"), context.join(ends, "doc_id"), F.col("c_end") + 1, F.col("c_last"), ["doc_id"]).select(*FIELDS, "_o", "c_pre")
        if s.axis == "preceding":
            found = containment.pairs(pool, F.col("pre"), context, F.lit(0), F.col("c_pre") - 1, ["doc_id"])
            return found.filter("post < c_post").select(*FIELDS, "_o", "c_pre")
        found = containment.pairs(context, F.col("c_pre"), pool, F.col("pre") + (0 if own else 1), F.col("pre") + size(), ["doc_id"]).select(*FIELDS, "_o", "c_pre")
        if s.test == "node()":
            above = self.root().join(now.select("doc_id", "_o", F.col("pre").alias("c_pre")), "doc_id")
            found = found.unionByName(above.select(*FIELDS, "_o", "c_pre"))
            if own:
                found = found.unionByName(roots.select(*FIELDS, "_o", F.col("pre").alias("c_pre")))
        return found

    def _step(self, now: DataFrame, s: Step) -> DataFrame:
        context = now.select(*[F.col(x).alias(f"c_{x}") for x in ("doc_id", "pre", "post", "parent", "ord", "kind")], "_o")
        if s.axis in ("self",):
            found = now.withColumn("c_pre", F.col("pre")).filter(test(s) if s.test != "node()" else F.lit(True))
        elif s.axis in _RANGES:
            found = self._ranged(now, s)
        else:
            on = (F.col("doc_id") == F.col("c_doc_id")) & _join(s.axis)
            if s.axis in ("following-sibling", "preceding-sibling"):
                on = on & ~F.col("c_kind").isin("attribute", "namespace")
            pool = self.nodes.filter(test(s))
            if s.axis == "parent" and s.test == "node()":
                pool = pool.unionByName(self.root())
            found = pool.join(context, on).select(*FIELDS, "_o", "c_pre")
        for p in s.predicates:
            found = self._keep(found, p, s.axis in REVERSE)
        return found.drop("c_pre").dropDuplicates(["doc_id", "_o", "pre"]) if s.axis not in ("self", "child", "attribute", "namespace") or s.predicates else found.drop("c_pre")

    def _keep(self, rows: DataFrame, p: object, reverse: bool) -> DataFrame:
        group = Window.partitionBy("doc_id", "_o", "c_pre")
        if X.positional(p):
            order = F.desc("pre") if reverse else F.asc("pre")
            rows = rows.withColumn("_position", F.row_number().over(group.orderBy(order)).cast("double")).withColumn("_last", F.count("*").over(group).cast("double"))
        rows, v = self.value(p, rows)
        keep = F.col("_position") == v.column if v.kind == "num" else v.as_("bool")
        kept = rows.filter(keep)
        return kept.select(*FIELDS, "_o", "c_pre")

    def nodeset(self, e: object, context: DataFrame | None) -> DataFrame:
        if isinstance(e, Path):
            return self.select(e, context)
        if isinstance(e, Binary) and e.op == "|":
            return self.nodeset(e.left, context).unionByName(self.nodeset(e.right, context)).dropDuplicates(["doc_id", "_o", "pre"])
        if isinstance(e, Filter):
            now = self.nodeset(e.expr, context).withColumn("c_pre", F.lit(-9))
            for p in e.predicates:
                now = self._keep(now, p, False)
            return now.drop("c_pre")
        if isinstance(e, Call) and e.name == "id" and isinstance(e.args[0], Literal):
            ids = self.nodes.filter((F.col("kind") == "attribute") & (F.col("name") == "id") & F.col("value").isin(e.args[0].value.split()))
            owners = ids.select("doc_id", F.col("parent").alias("pre"))
            return self.nodes.join(owners, ["doc_id", "pre"], "left_semi").withColumn("_o", F.lit(-1))
        raise XPathError("expected nodes")

    # -- values

    def _name(self) -> str:
        self.made += 1
        return f"_v{self.made}"

    @staticmethod
    def is_nodes(e: object) -> bool:
        return isinstance(e, (Path, Filter)) or isinstance(e, Binary) and e.op == "|" or isinstance(e, Call) and e.name == "id"

    def _attach(self, rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
        """Joins (doc_id, _o, name) to the context rows."""
        f = found.select(F.col("doc_id").alias(f"{name}_d"), F.col("_o").alias(f"{name}_o"), name)
        return rows.join(f, (rows["doc_id"] == F.col(f"{name}_d")) & (rows["pre"] == F.col(f"{name}_o")), "left").drop(f"{name}_d", f"{name}_o")

    def _exists(self, rows: DataFrame, found: DataFrame) -> tuple[DataFrame, _Typed]:
        name = self._name()
        flags = found.select("doc_id", "_o").distinct().withColumn(name, F.lit(True))
        return self._attach(rows, flags, name), _Typed(F.coalesce(F.col(name), F.lit(False)), "bool")

    def _context(self, rows: DataFrame) -> DataFrame:
        return rows.select(*FIELDS).dropDuplicates(["doc_id", "pre"])

    def _targets(self, e: object, rows: DataFrame) -> DataFrame:
        return self.nodeset(e, self._context(rows))

    def _leaves(self, e: object) -> bool:
        """Whether an expression gives only nodes that hold their string value themselves."""
        if isinstance(e, Binary):
            return e.op == "|" and self._leaves(e.left) and self._leaves(e.right)
        if isinstance(e, Filter):
            return self._leaves(e.expr)
        last = e.steps[-1] if isinstance(e, Path) and e.steps else None
        return last is not None and (last.axis in ("attribute", "namespace") or last.test in ("text()", "comment()") or last.test.startswith("processing-instruction("))

    def _texts(self, e: object, rows: DataFrame) -> DataFrame:
        found = self._targets(e, rows)
        return found.withColumn("text", F.coalesce("value", F.lit(""))) if self._leaves(e) else string_values(found, self.nodes)

    def value(self, e: object, rows: DataFrame) -> tuple[DataFrame, _Typed]:
        """Adds what an expression needs to the context rows, and says how to get its value."""
        if isinstance(e, Literal):
            return rows, _Typed(F.lit(e.value), "str")
        if isinstance(e, Number):
            return rows, _Typed(F.lit(float(e.value)), "num")
        if self.is_nodes(e):
            return self._exists(rows, self._targets(e, rows))
        if isinstance(e, Negative):
            rows, v = self._number(e.expr, rows)
            return rows, _Typed(-v, "num")
        if isinstance(e, Call):
            return self._call(e, rows)
        if isinstance(e, Binary):
            return self._binary(e, rows)
        raise XPathError(f"not supported over tables: {type(e).__name__}")

    def _string(self, e: object, rows: DataFrame) -> tuple[DataFrame, Column]:
        if self.is_nodes(e):
            name = self._name()
            first = self._texts(e, rows).groupBy("doc_id", "_o").agg(F.min_by("text", "pre").alias(name))
            rows = self._attach(rows, first, name)
            return rows, F.coalesce(F.col(name), F.lit(""))
        rows, v = self.value(e, rows)
        return rows, v.as_("str")

    def _number(self, e: object, rows: DataFrame) -> tuple[DataFrame, Column]:
        if self.is_nodes(e):
            rows, s = self._string(e, rows)
            return rows, number(s)
        rows, v = self.value(e, rows)
        return rows, v.as_("num")

    def _own(self, rows: DataFrame) -> tuple[DataFrame, Column]:
        return self._string(Path(False, (Step("self", "node()"),)), rows)

    def _aggregate(self, rows: DataFrame, found: DataFrame, column: Column, nothing: float) -> tuple[DataFrame, _Typed]:
        name = self._name()
        rows = self._attach(rows, found.groupBy("doc_id", "_o").agg(column.alias(name)), name)
        return rows, _Typed(F.coalesce(F.col(name), F.lit(nothing)), "num")

    def _call(self, e: Call, rows: DataFrame) -> tuple[DataFrame, _Typed]:
        f, args = e.name, e.args
        if f in ("position", "last"):
            return rows, _Typed(F.col("_position" if f == "position" else "_last"), "num")
        if f in ("true", "false"):
            return rows, _Typed(F.lit(f == "true"), "bool")
        if f in ("not", "boolean"):
            rows, v = self.value(args[0], rows)
            b = v.as_("bool")
            return rows, _Typed(~b if f == "not" else b, "bool")
        if f == "count":
            return self._aggregate(rows, self._targets(args[0], rows), F.count("*").cast("double"), 0.0)
        if f == "sum":
            return self._aggregate(rows, self._texts(args[0], rows), F.sum(number(F.col("text"))), 0.0)
        if f in ("name", "local-name", "namespace-uri"):
            if args and args[0] != Path(False, (Step("self", "node()"),)):
                name = self._name()
                first = self._targets(args[0], rows).groupBy("doc_id", "_o").agg(F.min_by(self._named(f), "pre").alias(name))
                return self._attach(rows, first, name), _Typed(F.coalesce(F.col(name), F.lit("")), "str")
            return rows, _Typed(F.coalesce(self._named(f), F.lit("")), "str")
        if f in ("number", "floor", "ceiling", "round"):
            rows, v = self._number(args[0], rows) if args else (lambda r, s: (r, number(s)))(*self._own(rows))
            out = {"number": v, "floor": F.floor(v).cast("double"), "ceiling": F.ceil(v).cast("double"), "round": F.floor(v + 0.5).cast("double")}[f]
            return rows, _Typed(F.when(F.isnan(v), v).otherwise(out), "num")
        if f == "lang":
            own = Path(False, (Step("ancestor-or-self", "*", (Path(False, (Step("attribute", "xml:lang"),)),)), Step("attribute", "xml:lang")))
            name = self._name()
            last = self._targets(own, rows).groupBy("doc_id", "_o").agg(F.max_by("value", "pre").alias(name))
            rows = self._attach(rows, last, name)
            rows, wanted = self._string(args[0], rows)
            tag = F.lower(F.coalesce(F.col(name), F.lit("")))
            return rows, _Typed((tag == F.lower(wanted)) | tag.startswith(F.concat(F.lower(wanted), F.lit("-"))), "bool")
        s: list[Column] = []
        numbers = {"substring": (1, 2)}.get(f, ())
        for i, a in enumerate(args):
            rows, c = (self._number if i in numbers else self._string)(a, rows)
            s.append(c)
        if not s and f in ("string", "string-length", "normalize-space"):
            rows, c = self._own(rows)
            s = [c]
        if f == "string":
            return rows, _Typed(s[0], "str")
        if f == "concat":
            return rows, _Typed(F.concat(*s), "str")
        if f == "starts-with":
            return rows, _Typed(s[0].startswith(s[1]), "bool")
        if f == "contains":
            return rows, _Typed(s[0].contains(s[1]), "bool")
        if f == "substring-before":
            at = F.position(s[1], s[0])
            return rows, _Typed(F.when(at > 0, F.substring(s[0], F.lit(1), at - 1)).otherwise(""), "str")
        if f == "substring-after":
            at = F.position(s[1], s[0])
            return rows, _Typed(F.when(at > 0, F.substring(s[0], at + F.char_length(s[1]), F.char_length(s[0]))).otherwise(""), "str")
        if f == "substring":
            a = F.floor(s[1] + 0.5)
            b = a + F.floor(s[2] + 0.5) if len(s) > 2 else F.char_length(s[0]) + 1.0
            start = F.greatest(a, F.lit(1)).cast("int")
            return rows, _Typed(F.when(F.isnan(s[1]) | (F.isnan(s[2]) if len(s) > 2 else F.lit(False)), "").otherwise(F.substring(s[0], start, F.greatest(F.lit(0), b.cast("int") - start))), "str")
        if f == "string-length":
            return rows, _Typed(F.char_length(s[0]).cast("double"), "num")
        if f == "normalize-space":
            return rows, _Typed(F.trim(F.regexp_replace(s[0], "[ \\t\\r\\n]+", " ")), "str")
        if f == "translate":
            return rows, _Typed(F.call_function("translate", *s), "str")
        raise XPathError(f"unknown function {f}()")

    @staticmethod
    def _named(f: str) -> Column:
        return {"local-name": F.col("name"), "namespace-uri": F.col("ns_uri"), "name": F.concat(F.when(F.col("prefix").isNotNull(), F.concat("prefix", F.lit(":"))).otherwise(""), F.col("name"))}[f]

    def _binary(self, e: Binary, rows: DataFrame) -> tuple[DataFrame, _Typed]:
        if e.op in ("and", "or"):
            rows, a = self.value(e.left, rows)
            rows, b = self.value(e.right, rows)
            return rows, _Typed(a.as_("bool") & b.as_("bool") if e.op == "and" else a.as_("bool") | b.as_("bool"), "bool")
        if e.op not in _OPS:
            rows, a = self._number(e.left, rows)
            rows, b = self._number(e.right, rows)
            out = {"+": a + b, "-": a - b, "*": a * b, "div": F.when(b == 0, F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))).otherwise(F.try_divide(a, b)), "mod": F.when(b == 0, float("nan")).otherwise(F.try_mod(a, b))}
            return rows, _Typed(out[e.op], "num")
        left, right, op = e.left, e.right, e.op
        if self.is_nodes(right) and not self.is_nodes(left):
            left, right, op = right, left, _MIRROR[op]
        if not self.is_nodes(left):
            rows, a = self.value(left, rows)
            rows, b = self.value(right, rows)
            kind = "num" if op not in ("=", "!=") else "bool" if "bool" in (a.kind, b.kind) else "num" if "num" in (a.kind, b.kind) else "str"
            return rows, _Typed(self._compared(a.as_(kind), b.as_(kind), op, kind == "num"), "bool")
        if self.is_nodes(right):
            a = self._texts(left, rows).select("doc_id", "_o", F.col("text").alias("_a"))
            b = self._texts(right, rows).select("doc_id", "_o", F.col("text").alias("_b"))
            same = F.col("_a"), F.col("_b")
            hit = a.join(b, ["doc_id", "_o"]).filter(self._compared(*(same if op in ("=", "!=") else map(number, same)), op, op not in ("=", "!=")))
            return self._exists(rows, hit)
        rows, v = self.value(right, rows)
        if v.kind == "bool":
            rows, some = self.value(left, rows)
            return rows, _Typed(self._compared(some.as_("bool"), v.column, op), "bool")
        name = self._name()
        rows = rows.withColumn(name, v.column)
        found = self._texts(left, rows)
        if isinstance(right, (Literal, Number)):  # the same for all rows
            found = found.withColumn(name, v.column)
        else:
            found = found.join(rows.select("doc_id", F.col("pre").alias("_o"), name).distinct(), ["doc_id", "_o"])
        text = F.col("text") if v.kind == "str" and op in ("=", "!=") else number(F.col("text"))
        other = F.col(name) if v.kind == "num" or op in ("=", "!=") else number(F.col(name))
        return self._exists(rows, found.filter(self._compared(text, other, op, not (v.kind == "str" and op in ("=", "!=")))))

    @staticmethod
    def _compared(a: Column, b: Column, op: str, numeric: bool = False) -> Column:
        """In numbers NaN is neither equal to nor above or below anything, itself included."""
        out = {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        return F.when(F.isnan(a) | F.isnan(b), F.lit(op == "!=")).otherwise(out) if numeric else out


def select(nodes: DataFrame, xpath: str, context: DataFrame | None = None) -> DataFrame:
    """The nodes that an expression gives in each document, rows of NODES. ``context``: rows to start relative paths from."""
    return Frames(nodes).nodeset(X.parse(xpath), context).select(*FIELDS).dropDuplicates(["doc_id", "pre"])


def evaluate(nodes: DataFrame, xpath: str) -> DataFrame:
    """(doc_id, value) of an expression that gives a number, string or boolean, once a document."""
    return Frames(nodes).once(X.parse(xpath))
