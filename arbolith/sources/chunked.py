"""One XML or JSON document of any size as rows of nodes, parsed by many tasks.

Files are cut behind a separator ("<" or ","), so Spark splits them like any text. Nothing says what a chunk's start is in the middle of, so each chunk is first looked
through for every state that it can begin in: what it closes of what is open before it, what it leaves open, and in what state it ends. These effects are chained
in order, a few hundred bytes a chunk, which tells each chunk its state, the open nodes around it and the piece of text that an unfinished node carries over. Then the chunks
are parsed at the same time with those nodes around them, and numbered by themselves; running sums of nodes opened and closed move their numbers to their places. Nodes
that are open over several chunks get their numbers from the chunk that opens them and from the one that closes them.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import NODES, Node, document, qualify
from . import json_tree, markup
from .brace import ParseError

#: Characters of a chunk, about.
SIZE = 1 << 20
SEPARATORS = {"xml": "<", "json": ","}

# -- effects

#: How what a chunk can begin in the middle of ends.
_ENDS = {"comment": "-->", "cdata": "]]>", "pi": "?>"}
_TAG = re.compile(r"<(?:/(?P<end>[^\s>]+)\s*>|(?P<start>[^\s/>!?]+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)")
_DOCTYPE = re.compile(r"<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>", re.DOTALL)
_XMLNS = re.compile(r"\s(xmlns(?::[^\s=]+)?)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_TOKEN = re.compile(r'"(?:[^"\\]+|\\.)*(?:"|\Z)|[{}\[\],:]', re.DOTALL)
_REST = re.compile(r'(?:[^"\\]+|\\.)*"', re.DOTALL)


def _plain(value: str) -> str:
    """An attribute's value as XML reads it."""
    named = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
    return re.sub(r"&(?:#x([0-9a-fA-F]+)|#([0-9]+)|(\w+));", lambda m: chr(int(m[1], 16)) if m[1] else chr(int(m[2])) if m[2] else named.get(m[3], ""), re.sub(r"[\t\n\r]", " ", value))


def _effect(state: str, closes: int, touched: bool, opened: list[dict], tail: int, head: str = "") -> dict:
    """``state`` at the end; nodes of before that are closed; whether the innermost one left then has children; nodes left open; where text begins that is carried over."""
    return {"state": state, "closes": closes, "touched": touched, "opened": opened, "tail": tail, "head": head}


def xml_effect(text: str, state: str = "content") -> dict:
    closes, touched, opened, started = 0, False, [], 0
    run = at = 0  # where texts began that no tag, comment or instruction has ended yet

    def child(node_too: bool = True) -> None:
        nonlocal touched
        if opened:
            opened[-1]["touched"] |= node_too
        else:
            touched |= node_too

    if state != "content":
        end = text.find(_ENDS[state])
        if end < 0:
            return _effect(state, 0, False, [], 0)
        at = end + len(_ENDS[state])
        if state != "cdata":
            run = at
            child()
    while (found := text.find("<", at)) >= 0:
        if not text.startswith("<![CDATA[", found):
            child(found > run)
        if m := _TAG.match(text, found):
            at = run = m.end()
            if m["end"] is not None:
                if opened:
                    opened.pop()
                else:
                    closes, touched = closes + 1, True
            else:
                child()
                if not m["attrs"].endswith("/"):
                    spaces = {k[6:]: _plain(a or b) for k, a, b in _XMLNS.findall(m["attrs"])} if "xmlns" in m["attrs"] else {}
                    opened.append({"at": started, "name": m["start"], "touched": False, "ns": spaces})
                started += 1
            continue
        kind = "comment" if text.startswith("<!--", found) else "cdata" if text.startswith("<![CDATA[", found) else "pi" if text.startswith("<?", found) else "doctype"
        if kind == "doctype":
            m = _DOCTYPE.match(text, found)
            if not m:
                raise ParseError("a tag or document type has no end", text, found)
            at = run = m.end()
            continue
        end = text.find(_ENDS[kind], found + (4 if kind == "comment" else 2))
        if end < 0:
            return _effect(kind, closes, touched, opened, run)
        at = end + len(_ENDS[kind])
        if kind != "cdata":
            run = at
            child()
    return _effect("content", closes, touched, opened, run)


def json_effect(text: str, state: str = "content") -> dict:
    closes, opened, started, at, head = 0, [], 0, 0, ""
    member, key, last, renames = 0, None, None, False
    if state == "string":
        m = _REST.match(text)
        if not m:
            return _effect("string", 0, False, [], 0)
        at, head, last = m.end(), text[: m.end() - 1], ""
    for m in _TOKEN.finditer(text, at):
        t = m[0]
        if t[0] == '"':
            if len(t) == 1 or t[-1] != '"' or (len(t) - len(t[:-1].rstrip("\\"))) % 2 == 0 and m.end() == len(text):
                return _effect("string", closes, False, opened, member, head)
            last = t
            if renames and opened and json_tree.NAME.match(t[1:-1]):
                opened[-1]["name"] = t[1:-1]
            renames = False
        elif t == ":":
            key, renames = last, last == '"_"'
        elif t == ",":
            member, key, renames = m.start(), None, False
        elif t in "{[":
            name = None if key is None else key and json.loads(key)
            opened.append({"at": started, "key": name, "close": "}" if t == "{" else "]", "name": None})
            started += 1
            member, key, renames = m.end(), None, False
        else:
            if opened:
                opened.pop()
            else:
                closes += 1
            member, key, renames = m.end(), None, False
    return _effect("content", closes, False, opened, len(text), head)


STATES = {"xml": (xml_effect, ("content", *_ENDS)), "json": (json_effect, ("content", "string"))}

# -- chunks parsed with what is open around them


def xml_forest(around: list[dict], raw: str, first: bool, trimmed: bool) -> tuple[list[Node], set[int], list[Node]]:
    """The document and the nodes around a chunk, with what the chunk puts into them; ids of those that it closes; elements that it opens."""
    spine = [document()]
    for e in around:
        prefix, _, local = e["name"].rpartition(":")
        spine.append(Node("element", local, prefix or None))
    at, opened = [spine[0]], []
    p = markup.expat_for(at, opened)
    try:
        if around:
            p.Parse("".join(f"<{e['name']}>" for e in around), False)
            at[:], spine[0].children, opened[:] = spine, [], []
        p.Parse(raw.removeprefix("﻿").lstrip() if first else raw, False)
    except markup.expat.ExpatError as e:
        raise ParseError(markup.expat.ErrorString(e.code), raw, 0) from None
    still = {id(n) for n in at}
    closed = {id(n) for n in [*spine, *opened] if id(n) not in still}
    if trimmed:
        for e, n in zip(around, spine[1:], strict=True):
            markup.trim_children(n, not e["touched"])
        markup.trim_children(spine[0])
        for n in opened:
            markup.trim_children(n)
    return spine, closed, opened


def json_forest(around: list[dict], raw: str, first: bool, trimmed: bool) -> tuple[list[Node], set[int], list[Node]]:
    spine = [document()]
    stack: list[tuple[Node, str]] = []
    for e in around:
        node = json_tree._named(e["key"] or "") if e["name"] is None else Node("element", e["name"].rpartition(":")[2], e["name"].rpartition(":")[0] or None)
        node.attrs = []
        spine.append(node)
        stack.append((node, e["close"]))
    opened: list[Node] = []
    names = [n.qname for n in spine]
    r = json_tree._Reader(raw.removeprefix("﻿") if first else raw)
    if around:
        json_tree.fill(r, spine[0], stack, None, opened)
    elif first:
        top = spine[0].add(Node("element", "_"))
        if r.space() not in ("{", "["):
            raise r.fail("expected a json container")
        json_tree.fill(r, spine[0], stack, top, opened)
    if not stack and r.space():
        raise r.fail("something follows the json value")
    still = {id(n) for n, _ in stack} | {id(spine[0])}
    if any(n.attrs for n in spine) or names != [n.qname for n in spine] or around and spine[0].children or first and stack and spine[0].children[-1] is not top:
        raise r.fail("an attribute or name comes too late for a container of this size")
    return spine, {id(n) for n in [*spine, *opened] if id(n) not in still}, opened


FORESTS: dict[str, Callable] = {"xml": xml_forest, "json": json_forest}


def rows(chunk: str, around: list[dict], forest: tuple[list[Node], set[int], list[Node]]) -> Iterator[tuple]:
    """What a chunk gives: ``what, key, up, pre, post, parent, level, ord, kind, prefix, name, ns_uri, value, path``.

    ``node``: a whole node. ``open`` and ``close``: halves of a node that isn't opened and closed in this chunk, by its key. ``kids``: how many nodes the chunk puts right below
    such a one (``ord``). ``sums``: nodes opened and closed. Numbers are the chunk's own; ``up`` is the key of a parent of before.
    """
    spine, closed, opened = forest
    keys = ["doc", *(e["id"] for e in around)]
    left = {id(n): f"{chunk}/{i}" for i, n in enumerate(opened) if id(n) not in closed}
    scope: dict[str, str] = {}
    scopes = [dict(scope)]
    paths = [""]
    for e, n in zip(around, spine[1:], strict=True):
        scope = scope | e.get("ns", {})
        scopes.append(scope)
        paths.append(f"{paths[-1]}/{n.qname}")
    pre = post = 0
    nothing = (None,) * 7
    for depth in range(len(spine) - 1, -1, -1):
        top = spine[depth]
        if top.children:
            holder = document()
            holder.children = top.children
            qualify(holder, scopes[depth])
            yield ("kids", keys[depth], None, None, None, None, None, len(top.children), *nothing[1:])
        # (node, own number of the parent, key of the parent, level, place, path above, number if it is being left)
        stack = [(c, None, keys[depth], depth, i, paths[depth], -1) for i, c in reversed(list(enumerate(top.children)))]
        while stack:
            node, parent, up, level, place, base, own = stack.pop()
            path = f"{base}/{node.qname}" if node.kind == "element" else f"{base}/@{node.qname}" if node.kind == "attribute" else base
            value = None if node.kind == "element" or node.kind == "attribute" and node.children else node.value
            facts = (node.kind, node.prefix, node.name, node.ns_uri, value, path)
            if own >= 0:
                yield ("node", None, up, own, post, parent, level, place, *facts)
                post += 1
                continue
            mine, below = pre, [*node.attrs, *node.children]
            pre += 1
            if key := left.get(id(node)):
                yield ("open", key, up, mine, None, parent, level, place, *facts)
                yield ("kids", key, None, None, None, None, None, len(below), *nothing[1:])
            else:
                stack.append((node, parent, up, level, place, base, mine))
            stack += [(c, mine, None, level + 1, i, path, -1) for i, c in reversed(list(enumerate(below)))]
        if depth == 0 or id(top) not in closed:
            break
        yield ("close", keys[depth], None, None, post, *nothing, None, None)
        post += 1
    yield ("sums", None, None, pre, post, *nothing, None, None)


# -- on Spark

_CHUNKS = "file string, block long, n long, text string"
_EFFECTS = "file string, block long, n long, effects string"
_ENTRIES = "file string, block long, n long, entry string"
_PART_FIELDS = "what string, key string, up string, pre long, post long, parent long, level int, ord long, kind string, prefix string, name string, ns_uri string, value string, path string"
_PARTS = f"file string, block long, n long, {_PART_FIELDS}"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in ddl.split(", ")])


def _batches(found: Iterator[tuple], ddl: str, most: int = 5000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    like, held, length = _schema(ddl), [], 0
    for r in found:
        held.append(r)
        length += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= most or length > size:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], f.type) for i, f in enumerate(like)], schema=like)
            held, length = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], f.type) for i, f in enumerate(like)], schema=like)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def cut(records: Iterator[tuple[str, str, int]], kind: str, size: int) -> Iterator[tuple]:
    """Chunks of what stands between separators. Each but a file's first begins with one; in XML each but a block's first with a tag."""
    separator = SEPARATORS[kind]
    for (file, block), group in itertools.groupby(records, lambda r: (r[1], r[2])):
        parts, length, n = [], 0, 0
        for i, (text, _, _) in enumerate(group):
            if length >= size and (kind == "json" or text[:1] not in ("!", "?")):
                yield file, block, n, "".join(parts)
                parts, length, n = [], 0, n + 1
            if block or i:
                parts.append(separator)
            parts.append(text)
            length += len(text) + 1
        if parts:
            yield file, block, n, "".join(parts)


def _chained(found: Iterator[tuple]) -> Iterator[tuple]:
    """Entries of chunks in order, from their effects."""
    for file, group in itertools.groupby(found, lambda r: r[0]):
        state, around, carry, problem = "content", [], "", None
        held = None
        for _, block, n, effects in group:
            if held is not None:
                yield held
            every = json.loads(effects)
            e = every.get(state) if problem is None else None
            if problem is None and "error" in (e or {"error": f"a chunk can't begin in a {state}"}):
                problem = e["error"] if e else "unknown state"
            entry = {"around": around, "carry": carry, "first": held is None, "problem": problem, "last": False}
            held = (file, block, n, entry)
            if problem is None:
                entry["tail"] = e["tail_length"]
                if e["closes"] > len(around):
                    problem = entry["problem"] = "something is closed that isn't open"
                    continue
                around = [dict(x) for x in around[: len(around) - e["closes"]]]
                if around and e["touched"]:
                    around[-1]["touched"] = True
                for x in e["opened"]:
                    x["id"] = f"{block}-{n}/{x['at']}"
                    if "key" in x and x["key"] == "":  # a key that began in a chunk before
                        x["key"] = json.loads(carry[carry.index('"') :] + e["head"] + '"')
                    around.append(x)
                carry = carry + e["carried"] if e["tail"] == 0 else e["carried"]
                state = e["state"]
        if held is not None:
            held[3]["last"] = True
            if around and problem is None:
                held[3]["problem"] = "the document has no end"
            yield held


#: Bits of a place in one of several files of a document.
_FILE_BITS = 40


def _name(file: str) -> str:
    return unquote(file.rsplit("/", 1)[-1])


def read(spark: SparkSession, path: str, kind: str, where: str, size: int = SIZE, trim: bool = True, parts: bool = False) -> DataFrame:
    """Rows of NODES of the XML or JSON files of ``path``; ids are hashes of the files' paths, as in ``readers.files``.

    A file that can't be parsed gives a row of kind error for each chunk in which that shows. Chunks and what is found in them are written to ``where``, a new folder that driver
    and executors share. A value has to fit into memory, a document need not. Bounds: entities that a document type declares are known in its first chunk; a JSON
    container of several chunks has to have its attributes and name in the first, and the top is a container.

    ``parts``: the files of the folder ``path`` are one document, in the order of their names, as many tasks wrote it; its id is the hash of ``path``. Each file but the first has to
    begin with what separates chunks, a tag in XML and a comma in JSON.
    """
    effect, states = STATES[kind]
    raw = spark.read.option("lineSep", SEPARATORS[kind]).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    places = {_name(f): i for i, f in enumerate(sorted(raw.inputFiles(), key=_name))} if parts else None

    def chunked(records: Iterator[tuple]) -> Iterator[tuple]:
        for file, block, n, text in cut(records, kind, size):
            yield (path, (places[_name(file)] << _FILE_BITS) + block, n, text) if parts else (file, block, n, text)

    raw.mapInArrow(lambda b: _batches(chunked(_records(b)), _CHUNKS, 8), _CHUNKS).write.parquet(f"{where}/chunks")
    chunks = spark.read.schema(_CHUNKS).parquet(f"{where}/chunks")

    def looked(file: str, block: int, n: int, text: str) -> tuple:
        found = {}
        for s in states:
            try:
                e = effect(text, s)
                found[s] = e | {"tail_length": len(text) - e["tail"], "carried": text[e["tail"] :]}
            except ParseError as x:
                found[s] = {"error": str(x)}
        return file, block, n, json.dumps(found)

    effects = chunks.mapInArrow(lambda b: _batches((looked(*r) for r in _records(b)), _EFFECTS), _EFFECTS)
    in_order = effects.repartition("file").sortWithinPartitions("file", "block", "n")
    in_order.mapInArrow(lambda b: _batches(((*r[:3], json.dumps(r[3])) for r in _chained(_records(b))), _ENTRIES), _ENTRIES).write.parquet(f"{where}/entries")
    entries = spark.read.schema(_ENTRIES).parquet(f"{where}/entries")
    nothing = (None,) * 7

    def parsed(file: str, block: int, n: int, text: str, entry: str) -> Iterator[tuple]:
        e = json.loads(entry)
        try:
            if e["problem"]:
                raise ParseError(e["problem"], "", 0)
            own = text if e["last"] else text[: len(text) - e["tail"]]
            whole = e["carry"] + own if e["last"] or e["tail"] < len(text) else ""
            forest = FORESTS[kind](e["around"], whole, e["first"], trim)
            for r in rows(f"{block}-{n}", e["around"], forest):
                yield (file, block, n, *r)
        except ValueError as x:
            yield (file, block, n, "error", *nothing, *nothing[:4], str(x), None)

    # dealt anew, as a block may have many chunks
    joined = chunks.join(entries, ["file", "block", "n"]).select("file", "block", "n", "text", "entry").repartition("file", "block", "n")
    joined.mapInArrow(lambda b: _batches((p for r in _records(b) for p in parsed(*r)), _PARTS), _PARTS).write.parquet(f"{where}/parts")
    made = spark.read.schema(_PARTS).parquet(f"{where}/parts")
    made.filter("what not in ('node', 'error')").write.parquet(f"{where}/few")
    return assembled(made, spark.read.schema(_PARTS).parquet(f"{where}/few"))


def assembled(parts: DataFrame, few: DataFrame | None = None) -> DataFrame:
    """Rows of NODES from what chunks give. ``few``: the rows that aren't whole nodes, a few a chunk, if they are stored by themselves.

    What nodes need of other chunks is put together to one row a chunk, so nodes are joined once, by their chunk. Most have no key, and all nodes right below the top have one: joins by keys
    would bring them to one task.
    """
    at = ["file", "block", "n"]
    few = parts.filter("what not in ('node', 'error')") if few is None else few
    before = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, -1)
    sums = few.filter("what = 'sums'").select(*at, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("pre", "post")])
    earlier = Window.partitionBy("file", "key").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, -1)
    kids = few.filter("what = 'kids'").select(*at, "key", F.coalesce(F.sum("ord").over(earlier), F.lit(0)).alias("ord0"))
    left = few.filter("what = 'open'")
    opens = left.join(sums, at).select("file", "key", (F.col("pre") + F.col("pre0")).alias("above"))
    ends = few.filter("what = 'close'").join(sums, at).select("file", "key", (F.col("post") + F.col("post0")).alias("end"))
    by_key = lambda *values: F.map_from_entries(F.collect_list(F.struct("key", F.struct(*values))))
    ups = kids.join(opens, ["file", "key"], "left").groupBy(*at).agg(by_key("ord0", "above").alias("ups"))
    closed = left.select(*at, "key").join(ends, ["file", "key"]).groupBy(*at).agg(by_key("end").alias("ends"))
    known = parts.filter("what in ('node', 'open')").join(sums.join(ups, at, "left").join(closed, at, "left"), at)
    known = known.withColumns({"_up": F.try_element_at("ups", F.col("up")), "_end": F.try_element_at("ends", F.col("key"))})
    nodes = known.select(
        F.xxhash64("file").alias("doc_id"), (F.col("pre") + F.col("pre0")).cast("int").alias("pre"), F.coalesce(F.col("post") + F.col("post0"), F.col("_end")["end"]).cast("int").alias("post"),
        F.coalesce(F.col("parent") + F.col("pre0"), F.col("_up")["above"], F.lit(-1)).cast("int").alias("parent"), "level", (F.col("ord") + F.coalesce(F.col("_up")["ord0"], F.lit(0))).cast("int").alias("ord"),
        "kind", "prefix", "name", "ns_uri", "value", "path",
    )
    bad = parts.filter("what = 'error'").select(F.xxhash64("file").alias("doc_id"), *[F.expr(f"cast({v} as {t}) as {c}") for c, t, v in _ERROR])
    return nodes.unionByName(bad)


_ERROR = [(c, t, "value" if c == "value" else "'error'" if c == "kind" else "''" if c == "path" else "-1" if c == "parent" else "0" if t == "int" else "null") for c, t in (x.split() for x in NODES.split(", ")[1:])]
