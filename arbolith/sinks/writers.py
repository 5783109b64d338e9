"""Tables of nodes as one text for each document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FIELDS, Node, build
from . import brace_out, json_out, markup


def renderer(kind: str, **options) -> Callable[[Node], str]:
    """brace, xml, html, json, text or clines. Options of brace: compact, indent, newlines, tabs, non_ascii, prefer_double; of xml: declaration."""
    if kind == "brace":
        return brace_out.Printer(**options).render
    if kind == "xml":
        return lambda doc: markup.xml(doc, options.get("declaration", True))
    return {"html": markup.html, "json": json_out.render, "text": markup.text, "clines": markup.clines}[kind]


def gathered(nodes: DataFrame) -> DataFrame:
    """(doc_id, nodes): each document's rows as one array; a document has to fit into memory, a table need not."""
    return nodes.groupBy("doc_id").agg(F.collect_list(F.struct(*[f for f in FIELDS if f != "doc_id"])).alias("nodes"))


def trees(nodes: DataFrame, use: Callable[[Node], str | None], out: str = "text") -> DataFrame:
    """(doc_id, ``out``): what ``use`` makes of each document's tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [use(build(rows)) for rows in part.column("nodes").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.string())], ["doc_id", out])

    return gathered(nodes).mapInArrow(run, f"doc_id bigint, {out} string")


def render(nodes: DataFrame, kind: str, **options) -> DataFrame:
    """(doc_id, text) in one of the formats of ``renderer``."""
    return trees(nodes, renderer(kind, **options))


def quote_c(text: Column) -> Column:
    """C escapes, as an expression. Control characters without a name become two hexadecimal digits."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c, e in (('"', '\\"'), ("\a", "\\a"), ("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\v", "\\v"), ("\f", "\\f"), ("\r", "\\r")):
        out = F.replace(out, F.lit(c), F.lit(e))
    for n in (*range(1, 7), *range(14, 32), 127):
        out = F.replace(out, F.lit(chr(n)), F.lit(f"\\x{n:02X}"))
    return out


def clines(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, line): a path line for each leaf, without Python; in the order of pre they are the document's lines."""
    has_parts = nodes.filter("parent >= 0").select("doc_id", F.col("parent").alias("pre")).distinct().withColumn("_parts", F.lit(True)).hint("merge")
    rows = nodes.join(has_parts, ["doc_id", "pre"], "left")
    kind = F.col("kind")
    quoted = F.concat(F.lit('"'), quote_c(F.coalesce("value", F.lit(""))), F.lit('"'))
    line = (
        F.when((kind == "element") & F.col("_parts").isNull(), F.concat("path", F.lit('=""')))
        .when(kind.isin("attribute", "text", "cdata"), F.concat("path", F.lit("="), quoted))
        .when(kind == "namespace", F.concat("path", F.lit("/@xmlns"), F.when(F.col("name") != "", F.concat(F.lit(":"), "name")).otherwise(""), F.lit("="), quoted))
        .when(kind == "entity", F.concat("path", F.lit('="&'), "name", F.lit(';"')))
        .when(kind == "comment", F.concat("path", F.lit("//="), quoted))
        .when(kind == "doctype", F.concat("path", F.lit("/!DOCTYPE="), quoted))
        .when(kind == "pi", F.concat("path", F.lit("/?"), "name", F.lit("="), quoted))
    )
    return rows.select("doc_id", "pre", line.alias("line")).filter("line is not null")


def to_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, text): all text in document order, without Python; an entity prints as <ENTITY> and its name."""
    inside = nodes.filter("kind = 'attribute'").select("doc_id", F.col("pre").alias("parent")).hint("merge")
    shown = nodes.filter("kind in ('text', 'cdata', 'entity')").join(inside, ["doc_id", "parent"], "left_anti")
    piece = F.when(F.col("kind") == "entity", F.concat(F.lit("<ENTITY>"), "name")).otherwise(F.col("value")).alias("v")
    texts = shown.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pre", piece))).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["v"]), "").alias("text"))
    return nodes.select("doc_id").distinct().join(texts.hint("merge"), "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
