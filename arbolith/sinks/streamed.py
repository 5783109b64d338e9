"""Documents of any size as XML or JSON, written from their nodes in order, without gathering a document.

Each node gives a piece of text where it opens and one where it closes. Both places follow from its numbers alone: before a node opens, all nodes with lower numbers have opened and
all of these but the ones around it have closed. So pieces are dealt by (document, PLACES places in a row) and sorted, and each task writes such runs, in parts of bounded size. As places are
numbered, no sample has to say where ranges begin, for which the pieces would be made twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .markup import DECLARATION, HYPHEN_MARK

#: Characters of a part, about, and parts of a batch that comes out at most.
SIZE, ROWS = 1 << 20, 10_000
#: Places that one task writes in order; a part ends there.
PLACES = 1 << 16


def opens() -> Column:
    """Where a node's first piece stands, counted in pieces of its document."""
    return F.col("pre").cast("long") * 2 - F.col("level")


def closes() -> Column:
    return F.col("post").cast("long") * 2 + F.col("level") + 1


def _escaped(value: Column, quote: bool) -> Column:
    named = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")] if quote else []), ("\r", "&#13;")]
    for c, e in named:
        value = F.replace(value, F.lit(c), F.lit(e))
    return value


def xml_pieces(nodes: DataFrame) -> DataFrame:
    """(doc_id, place, piece): the text of each document as pieces. What an element and its attributes need of each other they get from windows over the element's number: one shuffle of these, no join."""
    name = F.concat(F.coalesce(F.concat("prefix", F.lit(":")), F.lit("")), "name")
    kind, value = F.col("kind"), F.coalesce("value", F.lit(""))
    size = F.col("post").cast("long") - F.col("pre") + F.col("level")
    head, element = kind.isin("attribute", "namespace"), kind == "element"
    of = Window.partitionBy("doc_id", "of")
    tags = nodes.filter(head | element).select("doc_id", "pre", "post", "level", "ord", "kind", "prefix", "name", "value", F.when(element, F.col("pre")).otherwise(F.col("parent")).alias("of"), size.alias("size"))
    tags = tags.withColumns({"heads": F.count_if(head).over(of), "in_heads": F.coalesce(F.sum(F.when(head, F.col("size") + 1)).over(of), F.lit(0))})
    tags = tags.withColumn("filled", F.max(F.when(element, F.col("size") > F.col("in_heads"))).over(of)).filter("filled is not null")  # none: no element has it
    end = F.when(F.col("filled"), ">").otherwise("/>")
    shown = F.when(kind == "namespace", F.concat(F.lit("xmlns"), F.when(F.col("name") != "", F.concat(F.lit(":"), "name")).otherwise(""))).otherwise(name)
    tail, start = F.when(F.col("ord") == F.col("heads") - 1, end).otherwise(""), F.concat(F.lit(" "), shown, F.lit('="'))
    opening = (
        F.when(element, F.concat(F.lit("<"), name, F.when(F.col("heads") == 0, end).otherwise("")))
        .when(F.col("size") == 0, F.concat(start, _escaped(value, True), F.lit('"'), tail)).otherwise(start)
    )
    # an element that isn't empty, and an attribute whose value has entities in it, close behind what stands in them
    closing = F.when(element & F.col("filled"), F.concat(F.lit("</"), name, F.lit(">"))).when(head & (F.col("size") > 0), F.concat(F.lit('"'), tail))
    both = F.array(F.struct(opens().alias("place"), opening.alias("piece")), F.struct(closes().alias("place"), closing.alias("piece")))
    ends = tags.select("doc_id", F.explode(both).alias("p")).select("doc_id", "p.place", "p.piece").filter("piece is not null")
    quoted = F.col("path").rlike("/@[^/]*$")
    comment = F.regexp_replace(value, "-(?=-)", f"-{HYPHEN_MARK}")
    leaf = (
        F.when(kind == "text", F.when(quoted, _escaped(value, True)).otherwise(_escaped(value, False)))
        .when(kind == "cdata", F.concat(F.lit("<![CDATA["), value, F.lit("]]>")))
        .when(kind == "entity", F.concat(F.lit("&"), "name", F.lit(";")))
        .when(kind == "comment", F.concat(F.lit("<!--"), comment, F.when(value.endswith("-"), HYPHEN_MARK).otherwise(""), F.lit("-->")))
        .when(kind == "pi", F.concat(F.lit("<?"), "name", F.lit(" "), value, F.lit("?>")))
        .when(kind == "doctype", F.concat(F.lit("<!DOCTYPE "), F.coalesce("value", F.lit("html")), F.lit(">\n")))
    )
    return ends.unionByName(nodes.filter(~(head | element)).select("doc_id", opens().alias("place"), leaf.alias("piece")).filter("piece is not null"))


#: Fixed values of JSON: short escapes.
_SHORT = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


def _json_string(value: Column) -> Column:
    for c, e in _SHORT:
        value = F.replace(value, F.lit(c), F.lit(e))
    for n in (*range(8), 11, *range(14, 32)):
        value = F.replace(value, F.lit(chr(n)), F.lit(f"\\u{n:04x}"))
    return F.concat(F.lit('"'), value, F.lit('"'))


def _scalar(value: Column) -> Column:
    """Whether a text would read as a number, true, false or null."""
    return value.isin("true", "false", "null") | F.regexp_like(value, F.lit(r"\A-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"))


def json_pieces(nodes: DataFrame) -> DataFrame:
    """(doc_id, place, piece): as ``xml_pieces``, for documents whose top is one element alone; others give no pieces.

    What a node prints depends on its parent and on its place among what that prints, so nodes are grouped by parent once and by parent and key once.
    """
    name = F.concat(F.coalesce(F.concat("prefix", F.lit(":")), F.lit("")), "name")
    kind, value = F.col("kind"), F.coalesce("value", F.lit(""))
    head = kind.isin("attribute", "namespace")
    plain = head & (kind == "attribute") & name.isin("A", "S", "_")
    text = kind.isin("text", "cdata")
    named = nodes.withColumn("qname", name).filter(~F.col("path").rlike("/@[^/]*/") & ~(F.col("path").rlike("/@[^/]*$") & ~head))  # not what is in attributes
    below = named.groupBy("doc_id", F.col("parent").alias("pre")).agg(
        F.count_if(plain & (F.col("qname") == "A")).alias("array"), F.count_if(plain & (F.col("qname") == "S")).alias("marked"), F.max(F.when(plain & (F.col("qname") == "_"), value)).alias("own"),
        F.count_if(head & ~(plain & F.col("qname").isin("S", "_"))).alias("more"), F.count_if(text).alias("texts"), F.count_if(~head & ~text).alias("others"), F.count_if(plain & (F.col("qname") == "_")).alias("keyed"),
    )
    tops = named.filter("parent = -1").groupBy("doc_id").agg(F.count("*").alias("tops"), F.count_if(kind == "element").alias("roots")).filter("tops = 1 and roots = 1").select("doc_id").hint("merge")
    elements = named.filter(kind == "element").join(below.hint("merge"), ["doc_id", "pre"], "left").join(tops, "doc_id", "left_semi")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("array", "marked", "more", "texts", "others", "keyed")}
    known = elements.withColumns(zero).withColumn("own_key", F.when((F.col("name") == "_") & (F.col("keyed") > 0), F.coalesce("own", F.lit(""))).otherwise(F.col("qname")))
    owners = known.select("doc_id", F.col("pre").alias("parent"), F.col("array").alias("in_array"))
    placed = known.join(owners.hint("merge"), ["doc_id", "parent"], "left").withColumn("in_array", F.coalesce("in_array", F.lit(1)))
    shapes = placed.withColumn("titled", (F.col("in_array") > 0) & (F.col("qname") != "_"))
    shapes = shapes.withColumn("leaf", ~F.col("titled") & (F.col("more") == 0) & (F.col("texts") > 0) & (F.col("others") == 0))
    about = shapes.select("doc_id", F.col("pre").alias("parent"), (F.col("array") > 0).alias("p_array"), F.col("titled").alias("p_titled"), F.col("leaf").alias("p_leaf"), F.col("name").alias("p_name"), (F.col("marked") > 0).alias("p_marked"))
    # what each parent prints: all but marks in an object, elements in an array
    facts = shapes.select("doc_id", "pre", "titled", "leaf", "array", "own_key")
    inner = named.join(about.hint("merge"), ["doc_id", "parent"]).join(facts.hint("merge"), ["doc_id", "pre"], "left")
    mark = F.when(kind == "element", F.concat(F.lit("e"), "own_key")).when(text, "|").when(kind == "comment", "//").when(kind == "entity", "&").when(head, F.concat(F.lit("a"), "kind", "qname"))
    shown = F.when(F.col("p_array"), kind == "element").otherwise((~plain | (F.col("qname") == "_") & (F.col("p_name") != "_")) & ~kind.isin("pi", "doctype"))
    printed = inner.withColumn("mark", mark).filter("not p_leaf").filter(shown)
    same = Window.partitionBy("doc_id", "parent", "mark")
    counted = printed.withColumns({"alike": F.count("*").over(same), "number": F.row_number().over(same.orderBy("ord")) - 1})
    firsts = printed.groupBy("doc_id", "parent").agg(F.min("ord").alias("first"))
    members = counted.join(firsts.hint("merge"), ["doc_id", "parent"])
    comma = F.when(F.col("p_titled") & ~F.col("p_array") | (F.col("ord") > F.col("first")), ",").otherwise("")
    index = F.when(F.col("alike") > 1, F.concat(F.lit("["), F.col("number").cast("string"), F.lit("]"))).otherwise("")
    anonymous = (F.col("qname") == "_") & (F.col("own_key") == "_") & (F.col("alike") == 1) & ~F.coalesce(F.col("own_named"), F.lit(False))
    own_named = shapes.select("doc_id", "pre", ((F.col("keyed") > 0) & (F.col("name") == "_")).alias("own_named"))
    members = members.join(own_named.hint("merge"), ["doc_id", "pre"], "left")
    attribute = F.concat(_json_string(F.concat(F.lit("_"), F.when(kind == "namespace", F.concat(F.lit("xmlns"), F.when(F.col("name") != "", F.concat(F.lit(":"), "name")).otherwise(""))).otherwise(F.col("qname")))), F.lit(":"), F.when((kind == "attribute") & F.col("value").isNull(), "null").otherwise(_json_string(value)))
    key = F.when(F.col("p_array"), "").otherwise(F.concat(_json_string(F.when(anonymous, "").otherwise(F.concat("own_key", index))), F.lit(":")))
    opening = F.when(F.col("leaf"), "").when(F.col("array") > 0, "[").otherwise(F.concat(F.lit("{"), F.when(F.col("titled"), F.concat(F.lit('"_":'), _json_string(F.col("qname")))).otherwise("")))
    marked = lambda m, v: F.concat(F.lit(f'"{m}'), index, F.lit('":'), v)
    piece = (
        F.when(kind == "element", F.concat(key, opening)).when(head, attribute).when(text, marked("|", F.when(_scalar(value), value).otherwise(_json_string(value))))
        .when(kind == "comment", marked("//", _json_string(value))).when(kind == "entity", marked("&", _json_string(F.concat(F.lit("&"), "name", F.lit(";")))))
    )
    out = members.select("doc_id", opens().alias("place"), F.concat(comma, piece).alias("piece"))
    roots = shapes.filter("parent = -1").select("doc_id", opens().alias("place"), opening.alias("piece"))
    ends = shapes.filter("not leaf").select("doc_id", closes().alias("place"), F.when(F.col("array") > 0, "]").otherwise("}").alias("piece"))
    # the texts of a leaf are its scalar: written in one piece, where the first one stands
    texts = named.filter(text).join(about.filter("p_leaf").hint("merge"), ["doc_id", "parent"]).groupBy("doc_id", "parent", "p_marked").agg(F.min(F.struct(opens().alias("place"))).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", value.alias("v")))), lambda x: x["v"]), "").alias("all"))
    scalars = texts.select("doc_id", F.col("at.place").alias("place"), F.when(_scalar(F.col("all")) & ~F.col("p_marked"), F.col("all")).otherwise(_json_string(F.col("all"))).alias("piece"))
    return out.unionByName(roots).unionByName(ends).unionByName(scalars)


def _parts(batches: Iterator[pa.RecordBatch], size: int, places: int = PLACES) -> Iterator[pa.RecordBatch]:
    doc, start, until, held, length = None, 0, 0, [], 0
    made: list[tuple] = []  # parts of one batch, of about SIZE characters in all
    waiting = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "place", "text"])

    for batch in batches:
        for d, p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (d != doc or length >= size or p >= until):
                made.append((doc, start, "".join(held)))
                waiting += length
                held, length = [], 0
                if waiting >= SIZE or len(made) >= ROWS:
                    yield out()
                    made, waiting = [], 0
            if not held:
                doc, start, until = d, p, (max(p, 0) // places + 1) * places
            held.append(t)
            length += len(t)
    if held:
        made.append((doc, start, "".join(held)))
    if made:
        yield out()


def parts(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, place, text): the pieces of each document put together to parts of about ``size`` characters, in the order of ``place``."""
    places = PLACES
    dealt = pieces.repartition("doc_id", F.expr(f"greatest(place, 0) div {places}")).sortWithinPartitions("doc_id", "place")
    return dealt.select("doc_id", "place", "piece").mapInArrow(lambda b: _parts(b, size, places), "doc_id long, place long, text string")


def xml(nodes: DataFrame, declaration: bool = True, size: int = SIZE) -> DataFrame:
    """(doc_id, place, text): documents as parts of XML; put together by place they are what ``writers.render`` gives. ``nodes`` is used several times: best a stored table.

    A document of a million nodes is many tasks' work, and no task holds more than a part.
    """
    pieces = xml_pieces(nodes)
    if declaration:
        heads = nodes.filter("pre = 0").select("doc_id", F.lit(-1).cast("long").alias("place"), F.lit(DECLARATION).alias("piece"))
        pieces = pieces.unionByName(heads)
    return parts(pieces, size)


def json(nodes: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, place, text): documents of one top element as parts of JSON; put together by place they are what ``writers.render`` gives."""
    return parts(json_pieces(nodes), size)
