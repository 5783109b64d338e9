"""Changes to documents, copy on write, over tables of nodes.

Each takes and gives rows of NODES. doc_id is the key of every join and window, so a table that is partitioned by it isn't
shuffled again. Joins of two sides that both grow with a table have the hint "merge": the sizes of its files, which pack numbers well, tell nothing
of what a broadcast would send through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import FIELDS, NODES, Node, char_of, document, shred
from ..plans import xpath as X
from ..plans import containment, xpath_frames
from ..sources import brace

#: Added to the numbers of nodes that come from elsewhere, so that they stand behind a document's own.
_FAR = 1 << 30


def _numbered(rows: DataFrame) -> DataFrame:
    """Gapless pre, post, parent and ord.

    Document order is by _group, pre, _sub; the order of ends by _group, post, _end; the parent of a row is the row whose pre and
    _sub are its parent and _parent_sub. Columns of these that are missing are 0. Levels and paths have to be right.
    """
    for c in ("_group", "_sub", "_end", "_parent_sub"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(0))
    new = rows.withColumn("_pre", F.row_number().over(Window.partitionBy("doc_id").orderBy("_group", "pre", "_sub")) - 1).withColumn("_post", F.row_number().over(Window.partitionBy("doc_id").orderBy("_group", "post", "_end")) - 1)
    parents = new.select("doc_id", F.col("pre").alias("parent"), F.col("_sub").alias("_parent_sub"), F.col("_pre").alias("_parent"))
    out = new.join(parents.hint("merge"), ["doc_id", "parent", "_parent_sub"], "left").withColumn("parent", F.coalesce("_parent", F.lit(-1)))
    out = out.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("_pre")) - 1).withColumns({"pre": F.col("_pre"), "post": F.col("_post")})
    return out.select(*[F.col(f).cast("int").alias(f) if f in ("pre", "post", "parent", "level", "ord") else F.col(f) for f in FIELDS])


def _without(nodes: DataFrame, tops: DataFrame, tops_too: bool = True) -> DataFrame:
    t = tops.select("doc_id", (F.col("pre") + (0 if tops_too else 1)).alias("t_first"), (F.col("pre") + xpath_frames.size()).alias("t_last"))
    inside = containment.pairs(nodes.select("doc_id", "pre"), F.col("pre"), t, F.col("t_first"), F.col("t_last"), ["doc_id"])
    return nodes.join(inside.hint("merge"), ["doc_id", "pre"], "left_anti")


def _first(found: DataFrame) -> DataFrame:
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre"))).filter("_n = 1").drop("_n")


def snippet_rows(content: str | Node, kind: str = "brace") -> list[tuple]:
    """Rows of a small document, parsed on the driver; ids are 0."""
    from ..sources import readers

    return shred(readers.parse(content, kind) if isinstance(content, str) else content, 0)


def select(nodes: DataFrame, xpath: str, order: str = "reverse") -> DataFrame:
    """New documents of the nodes that ``xpath`` gives.

    Top-level nodes come in reverse document order, or with order="document" in that. A node of the result that is below
    another one stands by itself and is missing from the other's copy. An attribute becomes an element with its text.
    Documents without a match vanish.
    """
    found = xpath_frames.select(nodes, xpath)
    tops = found.select("doc_id", F.col("pre").alias("t_pre"), (F.col("pre") + xpath_frames.size()).alias("t_last"), F.col("level").alias("t_level"), F.col("path").alias("t_path"))
    owned = containment.pairs(nodes, F.col("pre"), tops, F.col("t_pre"), F.col("t_last"), ["doc_id"])
    nearest = owned.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "pre").orderBy(F.desc("t_pre")))).filter("_n = 1")
    top, attr = F.col("pre") == F.col("t_pre"), (F.col("pre") == F.col("t_pre")) & (F.col("kind") == "attribute")
    base = F.length(F.regexp_replace("t_path", "/[^/]*$", ""))
    keeps_name = ~top | F.col("kind").isin("element", "attribute")
    moved = nearest.withColumns({
        "_attr": attr,
        "_group": (F.lit(-1) if order == "reverse" else F.lit(1)) * F.col("t_pre"),
        "_sub": F.lit(0),
        "_end": F.lit(0),
        "level": F.col("level") - F.col("t_level"),
        "parent": F.when(~top, F.col("parent")),
        "path": F.when(keeps_name, F.regexp_replace(F.substring(F.col("path"), base + 1, F.length("path")), "^/@", "/")).otherwise(""),
    })
    none = F.lit(None).cast("string")
    texts = moved.filter("_attr and value is not null").withColumns({"_sub": F.lit(1), "_end": F.lit(-1), "kind": F.lit("text"), "level": F.lit(1), "prefix": none, "name": none, "ns_uri": none, "parent": F.col("pre")})
    plain = moved.withColumns({"kind": F.when(F.col("_attr"), "element").otherwise(F.col("kind")), "value": F.when(~F.col("_attr"), F.col("value"))})
    return _numbered(plain.unionByName(texts))


def delete(nodes: DataFrame, xpath: str) -> DataFrame:
    """Without the nodes that ``xpath`` gives and all below them. An invalid expression changes nothing."""
    try:
        X.parse(xpath)
    except X.XPathError:
        return nodes
    return _numbered(_without(nodes, xpath_frames.select(nodes, xpath)))


def _entities(nodes: DataFrame, name: str | None, attributes: bool) -> DataFrame:
    found = nodes.filter((F.col("kind") == "entity") & (F.col("name") == name if name else F.lit(True)))
    if attributes:
        return found
    return found.join(nodes.filter("kind = 'attribute'").select("doc_id", F.col("pre").alias("parent")).hint("merge"), ["doc_id", "parent"], "left_anti")


def delete_entity(nodes: DataFrame, name: str) -> DataFrame:
    """Without references to an entity, except for those in attributes."""
    return _numbered(_without(nodes, _entities(nodes, name, False)))


def merge_texts(nodes: DataFrame) -> DataFrame:
    """Adjacent text nodes as one; in attributes that have only text left, as the attribute's value."""
    text = F.col("kind") == "text"
    starts = F.when(text & (F.coalesce(F.lag("kind").over(Window.partitionBy("doc_id", "parent").orderBy("pre")), F.lit("")) == "text"), 0).otherwise(1)
    marked = nodes.withColumn("_start", starts)
    marked = marked.withColumn("_run", F.sum("_start").over(Window.partitionBy("doc_id", "parent").orderBy("pre")))
    run = Window.partitionBy("doc_id", "parent", "_run").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joined = marked.withColumn("value", F.when(text, F.array_join(F.collect_list("value").over(run), "")).otherwise(F.col("value"))).filter("_start = 1").drop("_start", "_run")
    inside = Window.partitionBy("doc_id", "parent")
    owners = joined.filter("kind = 'attribute'").select("doc_id", F.col("pre").alias("parent"))
    lone = joined.join(owners.hint("merge"), ["doc_id", "parent"], "left_semi").withColumn("_n", F.count("*").over(inside)).filter("_n = 1 and kind = 'text'")
    values = lone.select("doc_id", F.col("parent").alias("pre"), F.col("value").alias("_value"))
    folded = joined.join(lone.select("doc_id", "pre").hint("merge"), ["doc_id", "pre"], "left_anti").join(values.hint("merge"), ["doc_id", "pre"], "left").withColumn("value", F.coalesce("_value", "value"))
    return _numbered(folded.select(*FIELDS))


def replace(nodes: DataFrame, xpath: str, value: str) -> DataFrame:
    """With ``value`` as the content of the first node of each document that ``xpath`` gives; no match, no change."""
    first = _first(xpath_frames.select(nodes, xpath))
    target = first.select("doc_id", "pre", F.lit(True).alias("_hit")).hint("merge")
    emptied = _without(nodes, first, False).join(target, ["doc_id", "pre"], "left")
    holds = F.col("kind") == "element"
    plain = emptied.withColumn("value", F.when(F.col("_hit") & ~holds, value).otherwise(F.col("value"))).withColumns({"_sub": F.lit(0), "_end": F.lit(0)})
    none = F.lit(None).cast("string")
    added = emptied.filter(F.col("_hit") & holds).withColumns({"_sub": F.lit(1), "_end": F.lit(-1), "kind": F.lit("text"), "level": F.col("level") + 1, "prefix": none, "name": none, "ns_uri": none, "value": F.lit(value), "parent": F.col("pre")})
    # attributes of the element are above its new content in document order
    attrs = nodes.filter("kind in ('attribute', 'namespace')").join(target.select("doc_id", F.col("pre").alias("parent")), ["doc_id", "parent"], "left_semi").withColumns({"_hit": F.lit(None).cast("boolean"), "_sub": F.lit(0), "_end": F.lit(0)})
    last = attrs.groupBy("doc_id").agg(F.max("pre").alias("_last")).hint("merge")
    behind = added.join(last, "doc_id", "left").withColumn("pre", F.coalesce("_last", "pre")).drop("_last")
    return _numbered(plain.unionByName(attrs.select(*plain.columns)).unionByName(behind.select(*plain.columns)))


def replace_argument(nodes: DataFrame, argument: str) -> DataFrame:
    """``replace`` from XPATH=VALUE, cut at the first equals sign."""
    xpath, equals, value = argument.partition("=")
    if not equals:
        raise X.XPathError("replace needs XPATH=VALUE")
    return replace(nodes, xpath, value)


def replace_entity(nodes: DataFrame, name: str, text: str) -> DataFrame:
    """With ``text`` for each reference to an entity, in attributes too; it becomes one with the text around it."""
    hit = (F.col("kind") == "entity") & (F.col("name") == name)
    return merge_texts(nodes.withColumns({"value": F.when(hit, text).otherwise(F.col("value")), "kind": F.when(hit, "text").otherwise(F.col("kind")), "name": F.when(~hit, F.col("name"))}))


def replace_entity_with_tree(nodes: DataFrame, name: str, content: str | Node, kind: str = "brace") -> DataFrame:
    """With the first top-level node of a parsed document for each reference to an entity outside attributes."""
    tree = brace.parse(content) if isinstance(content, str) and kind == "brace" else content
    if isinstance(tree, str):
        from ..sources import readers

        tree = readers.parse(tree, kind)
    rows = shred(document(tree.children[0]), 0)  # a snippet: small
    sub = nodes.sparkSession.createDataFrame(rows, NODES).select(*[F.col(f).alias(f"s_{f}") for f in FIELDS])
    hits = _entities(nodes, name, False)
    put = hits.crossJoin(F.broadcast(sub)).select(
        "doc_id", "pre", "post", F.when(F.col("s_parent") < 0, F.col("parent")).otherwise(F.col("pre")).alias("parent"), (F.col("level") + F.col("s_level")).alias("level"), F.col("s_ord").alias("ord"),
        *[F.col(f"s_{f}").alias(f) for f in ("kind", "prefix", "name", "ns_uri", "value")], F.concat("path", "s_path").alias("path"),
        F.col("s_pre").alias("_sub"), F.col("s_post").alias("_end"), F.when(F.col("s_parent") < 0, 0).otherwise(F.col("s_parent")).alias("_parent_sub"),
    )
    rest = _without(nodes, hits).withColumns({"_sub": F.lit(0), "_end": F.lit(0), "_parent_sub": F.lit(0)})
    return _numbered(rest.unionByName(put))


def substitute_entity(nodes: DataFrame, name: str | None = None) -> DataFrame:
    """With characters for references: all numeric ones, decimal or hexadecimal, or those of one name."""
    num = F.regexp_extract("name", "^#x?([0-9A-Fa-f]+)$", 1)
    code = F.when(F.col("name").startswith("#x"), F.conv(num, 16, 10)).otherwise(F.when(F.col("name").startswith("#"), num)).try_cast("int")
    char = F.when(code.isNotNull(), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit(None))
    hit = (F.col("kind") == "entity") & (F.col("name") == name if name else F.col("name").startswith("#"))
    if name:
        char = F.lit(char_of(name))
    hit = hit & char.isNotNull()
    return merge_texts(nodes.withColumns({"value": F.when(hit, char).otherwise(F.col("value")), "kind": F.when(hit, "text").otherwise(F.col("kind")), "name": F.when(~hit, F.col("name"))}))


def add(nodes: DataFrame, content: str | Node) -> DataFrame:
    """With the top-level nodes of a brace-syntax snippet behind the last one of each document."""
    rows = snippet_rows(content)  # small, written by hand
    sub = nodes.sparkSession.createDataFrame(rows, NODES).drop("doc_id")
    far = sub.withColumns({"pre": F.col("pre") + _FAR, "post": F.col("post") + _FAR, "parent": F.when(F.col("parent") >= 0, F.col("parent") + _FAR)})
    return _numbered(nodes.unionByName(nodes.select("doc_id").distinct().crossJoin(F.broadcast(far)).select(*FIELDS)))


def add_root(nodes: DataFrame, name: str) -> DataFrame:
    """With one element around all top-level nodes of each document."""
    inner = nodes.select("doc_id", *[F.col(f) + 1 for f in ("pre",)], "post", (F.col("parent") + 1).alias("parent"), (F.col("level") + 1).alias("level"), "ord", "kind", "prefix", "name", "ns_uri", "value", F.concat(F.lit(f"/{name}"), "path").alias("path")).toDF(*FIELDS)
    none = F.lit(None).cast("string")
    roots = nodes.groupBy("doc_id").agg(F.count("*").cast("int").alias("n")).select("doc_id", F.lit(0), F.col("n"), F.lit(-1), F.lit(0), F.lit(0), F.lit("element"), none, F.lit(name), none, none, F.lit(f"/{name}")).toDF(*FIELDS)
    return inner.unionByName(roots)


def set_attribute(nodes: DataFrame, xpath: str, name: str, value: str) -> DataFrame:
    """With the attribute on all elements that ``xpath`` gives, in place of one of that name."""
    found = xpath_frames.select(nodes, xpath).filter("kind = 'element'")
    keys = found.select("doc_id", F.col("pre").alias("parent")).hint("merge")
    old = nodes.filter((F.col("kind") == "attribute") & (F.col("name") == name)).join(keys, ["doc_id", "parent"], "left_semi")
    rest = _without(nodes, old)
    last = rest.filter("kind in ('attribute', 'namespace')").groupBy("doc_id", F.col("parent").alias("pre")).agg(F.max("pre").alias("_last")).hint("merge")
    new = found.join(last, ["doc_id", "pre"], "left").withColumns({
        "parent": F.col("pre"), "pre": F.coalesce("_last", "pre"), "_sub": F.lit(1), "_end": F.lit(-1), "level": F.col("level") + 1,
        "kind": F.lit("attribute"), "prefix": F.lit(None).cast("string"), "ns_uri": F.lit(None).cast("string"), "name": F.lit(name), "value": F.lit(value), "path": F.concat("path", F.lit(f"/@{name}")),
    })
    ends = rest.filter("kind in ('attribute', 'namespace')").groupBy("doc_id", "parent").agg(F.max("post").alias("_after")).hint("merge")
    # it ends behind the attributes that are there, or else before the first node below
    start = F.col("parent") - (F.col("level") - 1)
    new = new.join(ends, ["doc_id", "parent"], "left").withColumn("_end", F.when(F.col("_after").isNotNull(), 1).otherwise(-1)).withColumn("post", F.coalesce("_after", start))
    plain = rest.withColumns({"_sub": F.lit(0), "_end": F.lit(0)})
    return _numbered(plain.unionByName(new.select(*plain.columns)))


def annotate_offsets(nodes: DataFrame, name: str = "offset") -> DataFrame:
    """Each node with ``name``: bytes of text before it in its document."""
    own = F.when(F.col("kind").isin("text", "cdata"), F.octet_length("value")).otherwise(0)
    return nodes.withColumn(name, F.coalesce(F.sum(own.cast("long")).over(Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
