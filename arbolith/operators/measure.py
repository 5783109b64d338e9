"""Counts, typed values and templates over tables of nodes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import xpath_frames

#: Counters of ``statistics`` in the order in which they print; those of the second kind print even if 0.
COUNTERS = (
    "size_source", "num_elements", "size_element_names", "num_text_nodes", "size_text_nodes", "num_attributes", "size_attribute_names", "size_attribute_content", "num_comments", "size_comments", "size_doctype",
    "num_cdata_nodes", "size_cdata_nodes", "num_text_nodes_with_single_quotes", "num_text_nodes_with_double_quotes", "num_text_nodes_with_no_quotes", "num_text_nodes_with_any_quotes", "num_text_nodes_with_both_quotes", "sum_meta", "sum_text",
)
ALWAYS = ("size_source", "sum_meta", "sum_text")


def statistics(nodes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """A row of COUNTERS for each document, sizes in bytes. ``sources``: (doc_id, size_source). One aggregation, no Python."""
    inside = nodes.filter("kind = 'attribute'").select("doc_id", F.col("pre").alias("parent"))
    rows = nodes.filter("kind not in ('text', 'entity')").unionByName(nodes.filter("kind = 'text'").join(inside, ["doc_id", "parent"], "left_anti").select(*nodes.columns))
    of = lambda k: F.col("kind") == k
    count = lambda c: F.count_if(c).cast("long")
    size = lambda c, x: F.coalesce(F.sum(F.when(c, F.octet_length(x))), F.lit(0)).cast("long")
    name = F.concat(F.coalesce(F.concat("prefix", F.lit(":")), F.lit("")), "name")
    one, two = F.col("value").contains("'"), F.col("value").contains('"')
    text = of("text")
    out = rows.groupBy("doc_id").agg(
        count(of("element")).alias("num_elements"), size(of("element"), name).alias("size_element_names"),
        count(text).alias("num_text_nodes"), size(text, "value").alias("size_text_nodes"),
        count(of("attribute")).alias("num_attributes"), size(of("attribute"), name).alias("size_attribute_names"), size(of("attribute"), "value").alias("size_attribute_content"),
        count(of("comment")).alias("num_comments"), size(of("comment"), "value").alias("size_comments"), size(of("doctype"), "value").alias("size_doctype"),
        count(of("cdata")).alias("num_cdata_nodes"), size(of("cdata"), "value").alias("size_cdata_nodes"),
        count(text & one).alias("num_text_nodes_with_single_quotes"), count(text & two).alias("num_text_nodes_with_double_quotes"), count(text & ~one & ~two).alias("num_text_nodes_with_no_quotes"),
        count(text & (one | two)).alias("num_text_nodes_with_any_quotes"), count(text & one & two).alias("num_text_nodes_with_both_quotes"),
    )
    out = out.withColumn("sum_meta", F.col("size_element_names") + F.col("size_attribute_names") + F.col("size_attribute_content") + F.col("size_doctype")).withColumn("sum_text", F.col("size_text_nodes"))
    out = out.join(sources.select("doc_id", "size_source"), "doc_id", "left") if sources is not None else out.withColumn("size_source", F.lit(None).cast("long"))
    return out.select("doc_id", *COUNTERS)


def statistics_document(counted: DataFrame) -> DataFrame:
    """(doc_id, text): the counters as a brace-syntax document, without zeros but for ALWAYS."""
    width = F.greatest(*[F.when(F.lit(c in ALWAYS) | (F.col(c) > 0), len(c)).otherwise(0) for c in COUNTERS])
    lines = [F.when(F.lit(c in ALWAYS) | (F.col(c) > 0), F.concat(F.lit("    "), F.rpad(F.lit(c), width, F.lit(" ")), F.lit(" = "), F.coalesce(F.col(c), F.lit(0)).cast("string"), F.lit("\n"))) for c in COUNTERS]
    return counted.select("doc_id", F.concat(F.lit("statistics {\n"), F.array_join(F.array_compact(F.array(*lines)), ""), F.lit("}\n")).alias("text"))


def c_integer(text: Column, kind: str = "long") -> Column:
    """An integer as C reads it: 0x hexadecimal, leading 0 octal, else the digits at the start; missing or garbage is 0."""
    t = F.coalesce(F.trim(text), F.lit(""))
    hexa, octal, plain = (F.regexp_extract(t, p, 1) for p in ("^0[xX]([0-9A-Fa-f]+)", "^0([0-7]*)", "^([+-]?[0-9]+)"))
    value = F.when(t.startswith("0x") | t.startswith("0X"), F.conv(hexa, 16, 10)).when(t.startswith("0"), F.conv(F.when(octal == "", "0").otherwise(octal), 8, 10)).otherwise(plain)
    return F.coalesce(value.try_cast(kind), F.lit(0).cast(kind))


def c_double(text: Column) -> Column:
    """A number as C reads it: the longest numeric start; missing or garbage is 0."""
    return F.coalesce(F.regexp_extract(F.coalesce(F.trim(text), F.lit("")), r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def first(nodes: DataFrame, xpath: str, context: DataFrame | None = None) -> DataFrame:
    """The first match in each document."""
    found = xpath_frames.select(nodes, xpath, context)
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre"))).filter("_n = 1").drop("_n")


def get_string(nodes: DataFrame, xpath: str) -> DataFrame:
    """(doc_id, value): the first match's own value, or the content of its first child; no row where there is no match."""
    top = first(nodes, xpath)
    child = nodes.filter("kind not in ('attribute', 'namespace')").select("doc_id", F.col("parent").alias("pre"), F.struct("ord", F.col("value").alias("v")).alias("c"))
    firsts = child.join(top.select("doc_id", "pre"), ["doc_id", "pre"], "left_semi").groupBy("doc_id", "pre").agg(F.min("c")["v"].alias("_child"))
    return top.join(firsts, ["doc_id", "pre"], "left").select("doc_id", F.coalesce("value", "_child").alias("value"))


def get_int(nodes: DataFrame, xpath: str) -> DataFrame:
    return get_string(nodes, xpath).withColumn("value", c_integer(F.col("value"), "int"))


def get_long(nodes: DataFrame, xpath: str) -> DataFrame:
    return get_string(nodes, xpath).withColumn("value", c_integer(F.col("value")))


def get_double(nodes: DataFrame, xpath: str) -> DataFrame:
    return get_string(nodes, xpath).withColumn("value", c_double(F.col("value")))


def single(nodes: DataFrame, xpath: str) -> DataFrame:
    """The only match in each document with ``error``: null, or TooMany; documents without a match are missing (NotFound)."""
    found = xpath_frames.select(nodes, xpath)
    return found.withColumn("error", F.when(F.count("*").over(Window.partitionBy("doc_id")) > 1, "TooMany"))


def foreach(nodes: DataFrame, xpath: str, template: str) -> DataFrame:
    """(doc_id, pre, line): the template for each match, with ${name} for a child's text, ${.} for its own and ${..} for its name.

    A match that is no element stands for its parent.
    """
    found = xpath_frames.select(nodes, xpath)
    parents = found.filter("kind != 'element'").select("doc_id", F.col("parent").alias("pre"))
    elements = found.filter("kind = 'element'").unionByName(nodes.join(parents, ["doc_id", "pre"], "left_semi").select(*found.columns)).dropDuplicates(["doc_id", "pre"])
    rows, parts, at = elements, [], 0
    frames = xpath_frames.Frames(nodes)
    from ..plans import xpath as X

    for m in re.finditer(r"\$\{([^}]*)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[1] == "..":
            parts.append(F.col("name"))
        else:
            rows, value = frames._string(X.parse(m[1]), rows)
            parts.append(value)
    parts.append(F.lit(template[at:]))
    return rows.select("doc_id", "pre", F.concat(*parts).alias("line"))


def sibling_index(nodes: DataFrame) -> DataFrame:
    """Elements with ``same_name``, how many siblings share the name, and ``index``, the place among these from 0."""
    group = Window.partitionBy("doc_id", "parent", "prefix", "name")
    elements = nodes.filter("kind = 'element'")
    return elements.withColumn("same_name", F.count("*").over(group)).withColumn("index", F.row_number().over(group.orderBy("pre")) - 1)


def codepoints(df: DataFrame, text: str) -> DataFrame:
    """The distinct characters of all texts, with how often they occur."""
    return df.select(F.explode(F.split(F.col(text), "")).alias("char")).filter("char != ''").groupBy("char").agg(F.count("*").alias("n"))
