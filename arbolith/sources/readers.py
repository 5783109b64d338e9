"""Tables of texts to rows of nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import FIELDS, NODES, Node, document, shred, text
from . import brace, json_tree, markup
from .detect import content_type, unfit, without_bom

_ARROW = pa.schema([(f, pa.int64() if f == "doc_id" else pa.int32() if f in ("pre", "post", "parent", "level", "ord") else pa.string()) for f in FIELDS])
#: Nodes that one output batch holds.
_BATCH = 50_000
#: Characters of a text from which its rows are made without its tree, where its kind allows.
_LARGE = 1 << 20
#: Rows of a stored table up to which Spark may broadcast what is taken from it.
BROADCAST_ROWS = 200_000


def parse_text(source: str, root: str | None = None) -> Node:
    leaf = text(source)
    if not root:
        return document(leaf)
    node = Node("element", root)
    node.add(leaf)
    return document(node)


def parse(source: str, kind: str, trim: bool | None = None, merge: bool = True, root: str | None = None) -> Node:
    """The tree of one text. ``trim``: by default of XML and HTML only. ``root``: put around unless it is there already."""
    if kind == "json":
        return json_tree.parse(source, root)
    if kind in ("text", "clines"):
        return parse_text(source, root)
    doc = brace.parse(source, merge) if kind == "brace" else markup.parse_xml(source, trim is not False) if kind == "xml" else markup.parse_html(source, trim is not False)
    tops = [c for c in doc.children if c.kind == "element"]
    if root and not (len(tops) == 1 and tops[0].name == root):
        node = Node("element", root)
        for c in doc.children:
            node.add(c)
        doc = document(node)
    return doc


def tree_rows(df: DataFrame, make: Callable[[dict], Node], doc_id: str = "doc_id", pieces: Callable[[dict], Iterator[list[tuple]] | None] = lambda row: None) -> DataFrame:
    """Rows of NODES of the trees that ``make`` makes of rows; a row of which it makes none, by a ValueError, gets one of kind error.

    ``pieces``: its rows without the tree, for a row of which that would be large, else None; an error has to come before the first piece.
    """

    def found(row: dict) -> Iterator[list[tuple]]:
        try:
            yield from pieces(row) or [shred(make(row), row[doc_id])]
        except ValueError as e:
            yield [(row[doc_id], 0, 0, -1, 0, 0, "error", None, None, None, str(e), "")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            step = 256 if batch.nbytes < _LARGE else 1  # texts that are strings at once
            for at in range(0, batch.num_rows, step):
                for row in batch.slice(at, step).to_pylist():
                    for rows in found(row):
                        out += rows
                        if len(out) >= _BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
                            out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    return df.mapInArrow(run, NODES)


def texts(df: DataFrame, content: Column | str, doc_id: Column | str = "doc_id", kind: str | None = None, forced: bool = False, keep: Iterable[str] = ()) -> DataFrame:
    """(doc_id, raw, type) and the columns ``keep`` of the texts that aren't null, without a byte order mark; with ``forced``, problem says why one can't be of that kind."""
    content = F.col(content) if isinstance(content, str) else content
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    columns = [doc_id.cast("long").alias("doc_id"), without_bom(content).alias("raw"), (F.lit(kind) if kind else content_type(content)).alias("type")]
    if forced and kind:
        columns.append(unfit(content, kind).alias("problem"))
    return df.select(*columns, *[F.col(f"`{c}`") for c in keep]).filter("raw is not null")


def maker(trim: bool | None = None, merge: bool = True, root: str | None = None) -> Callable[[dict], Node]:
    """What makes the tree of a row of ``texts``; a ValueError if the row has a problem."""

    def make(row: dict) -> Node:
        if problem := row.get("problem"):
            raise ValueError(problem)
        return parse(row["raw"], row["type"], trim, merge, root)

    return make


def nodes(df: DataFrame, content: Column | str, doc_id: Column | str = "doc_id", kind: str | None = None, trim: bool | None = None, merge: bool = True, root: str | None = None, forced: bool = False) -> DataFrame:
    """Rows of NODES of a column of texts.

    ``kind``: one of detect.TYPES, or None to detect each text's; with ``forced`` a text that looks like another kind isn't
    parsed. A text that can't be parsed gives one row of kind error with the message; a null text gives no rows. Parsing needs no shuffle.
    The rows of large XML are made while it is read, without its tree, and come in no order; so are those of small XML that is plain, in order.
    """
    large = _LARGE

    def pieces(row: dict) -> Iterator[list[tuple]] | None:
        if row["type"] == "xml" and root is None and not row.get("problem"):
            if len(row["raw"]) >= large:
                return markup.xml_rows(row["raw"], row["doc_id"], trim is not False)
            if rows := markup.plain_rows(row["raw"], row["doc_id"], trim is not False):
                return iter([rows])
        return None

    return tree_rows(texts(df, content, doc_id, kind, forced), maker(trim, merge, root), pieces=pieces)


def dealt(df: DataFrame, *by: Column | str) -> DataFrame:
    """Texts dealt to tasks before they are parsed, which costs more than moving a text: files of few bytes would be few tasks, or one."""
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism), *by)


def stored(nodes: DataFrame, path: str) -> DataFrame:
    """A table of nodes written once: plans that use one many times don't parse its texts again each time. ``path``: a new folder that driver and executors share."""
    nodes.write.parquet(path)
    return unbroadcast(nodes.sparkSession.read.schema(nodes.schema).parquet(path))


def unbroadcast(table: DataFrame) -> DataFrame:
    """A stored table whose joins are sorted and merged if it has many rows: its files pack numbers so well that by their size Spark would send millions of rows through the driver."""
    return table.hint("merge") if table.count() > BROADCAST_ROWS else table


def split_lines(df: DataFrame, content: Column | str, doc_id: Column | str = "doc_id") -> DataFrame:
    """(doc_id, line_no, line): each line of a column of texts, numbered from 0."""
    content = F.col(content) if isinstance(content, str) else content
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return df.select(doc_id.cast("long").alias("doc_id"), F.posexplode(F.split(content, "\n")).alias("line_no", "line"))


def docs(df: DataFrame, content: Column | str, doc_id: Column | str = "doc_id", source: str | None = None) -> DataFrame:
    """The docs table: doc_id, source, content_type, size_source, raw."""
    content = F.col(content) if isinstance(content, str) else content
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return df.select(doc_id.cast("long").alias("doc_id"), F.lit(source).alias("source"), content_type(content).alias("content_type"), F.octet_length(content).cast("long").alias("size_source"), content.alias("raw"))


def _placed(*parts: Column) -> Column:
    """An id from a place, the same in each run however files are split."""
    return F.xxhash64(*parts)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as docs; ids are hashes of their paths. Files in UTF-16 get a message in place of a type."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    mark = F.hex(F.substring("content", 1, 2))
    wide = mark.isin("FEFF", "FFFE")
    df = raw.select(_placed(F.col("path")).alias("doc_id"), F.col("path").alias("source"), F.length("content").cast("long").alias("size_source"), F.when(~wide, F.decode("content", "UTF-8")).alias("raw"), wide.alias("wide"))
    return df.select("doc_id", "source", F.when(F.col("wide"), "utf-16 is not supported").otherwise(content_type(F.col("raw"))).alias("content_type"), "size_source", "raw")


def lines(spark: SparkSession, path: str, offsets: bool = False) -> DataFrame:
    """Each line of text files as a document: docs with ``line_no``, the line's number in its file from 0; with ``offsets`` also ``offset``, its first byte there.

    Ids are hashes of the file's path and the line's number. Spark may split files anywhere: each block's lines are counted, and sums over the blocks before it move its
    numbers, so they are the same for all sizes of blocks. Only with ``offsets`` lines are shuffled, by their blocks.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    size = F.octet_length("value").cast("long") + 1
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("source", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(size).alias("bytes"))
    sums = blocks.select("source", "block", "first", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "bytes")])
    placed = raw.join(sums, ["source", "block"]).withColumn("line_no", F.col("at") - F.col("first") + F.col("n0"))
    if offsets:
        inside = Window.partitionBy("source", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("offset", F.col("bytes0") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    line = F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    return placed.select(
        _placed(F.col("source"), F.col("line_no")).alias("doc_id"), "source", content_type(line).alias("content_type"), F.octet_length(line).cast("long").alias("size_source"), line.alias("raw"),
        "line_no", *(["offset"] if offsets else []),
    )


def literal(spark: SparkSession, *contents: str) -> DataFrame:
    return docs(spark.createDataFrame(list(enumerate(contents)), "doc_id long, value string"), "value")


def empty(spark: SparkSession) -> DataFrame:
    """One document without content."""
    return literal(spark, "")
