"""The engine's queries over the test tables: name to (spark, sf_dir) -> DataFrame, each with the same in SQL where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .functions import text as T
from .grammar import registry
from .operators import measure, mutate
from .plans import pipeline, trees, xpath, xpath_frames, xpath_tree, xslt
from .plans.trees import Trees
from .sinks import coloured, writers
from .sources import detect, readers
from .streaming import lines as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# -- documents built from tables


def _nation_json(spark, sf_dir) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    return n.select(_long("n_nationkey").alias("doc_id"), F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("t"))


def _nation_brace(spark, sf_dir) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    return n.select(_long("n_nationkey").alias("doc_id"), F.concat(F.lit("nation{n_nationkey="), F.col("n_nationkey"), F.lit(" n_name='"), F.col("n_name"), F.lit("'n_regionkey="), F.col("n_regionkey"), F.lit("}")).alias("t"))


def _customer_xml(spark, sf_dir) -> DataFrame:
    """A document for each nation: customers with their segment and balance in whole units, by key."""
    c = _t(spark, sf_dir, "customer")
    one = F.concat(F.lit('<customer id="'), "c_custkey", F.lit('" seg="'), "c_mktsegment", F.lit('"><bal>'), F.floor("c_acctbal"), F.lit("</bal></customer>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", one.alias("x")))), lambda x: x["x"]), "")
    return c.groupBy("c_nationkey").agg(F.concat(F.lit("<nation>"), rows, F.lit("</nation>")).alias("t")).select(_long("c_nationkey").alias("doc_id"), "t")


def _customers(spark, sf_dir) -> DataFrame:
    return readers.nodes(_customer_xml(spark, sf_dir), "t", kind="xml")


def _pages(spark, sf_dir) -> DataFrame:
    return readers.nodes(_t(spark, sf_dir, "pages"), "html", "page_id", kind="html")


def _events(spark, sf_dir) -> Trees:
    return trees.of(_t(spark, sf_dir, "events"), "props", "event_id", kind="json", keep=["event_type"])


def _nations(spark, sf_dir) -> Trees:
    return trees.of(_nation_json(spark, sf_dir), "t", kind="json")


def _customer_trees(spark, sf_dir) -> Trees:
    return trees.of(_customer_xml(spark, sf_dir), "t", kind="xml")


def _page_trees(spark, sf_dir) -> Trees:
    return trees.of(_t(spark, sf_dir, "pages"), "html", "page_id", kind="html")


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.getConf().get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='arbolith-')).rstrip('/')}/arbolith/{uuid.uuid4().hex}"


# -- sources


def _detected(table: str, column: str):
    def run(spark, sf_dir):
        return _t(spark, sf_dir, table).groupBy(detect.content_type(F.col(column)).alias("type")).agg(F.count("*").alias("n"))

    return run


_DETECT = """SELECT CASE WHEN regexp_matches(lower({c}), '^\\s*<(html|!doctype\\s+html)') THEN 'html' WHEN ltrim({c}) LIKE '<%' THEN 'xml'
WHEN regexp_matches({c}, '^[ \\t\\r\\n]*[{{"\\[0-9]') THEN 'json' ELSE 'brace' END AS type, count(*) AS n FROM {t} GROUP BY 1"""
for _name, _table, _column in (("detect_type_pages", "pages", "html"), ("detect_type_props", "events", "props"), ("detect_type_docs", "documents", "text")):
    QUERIES[_name] = _detected(_table, _column)
    SQL[_name] = _DETECT.format(c=_column, t=_table)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def jsonl_select_k(spark, sf_dir):
    return _events(spark, sf_dir).first("/_/k").select(F.col("doc_id").alias("event_id"), measure.c_integer(F.col("value")).alias("k"))



@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 10 GROUP BY 1")
def jsonl_filter_agg(spark, sf_dir):
    k = measure.c_integer(F.col("value"))
    return _events(spark, sf_dir).first("/_/k").select("event_type", k.alias("k")).filter("k > 10").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))



@query("SELECT event_id AS doc_id, unnest([0, 1, 2]) AS pre, unnest([2, 1, 0]) AS post, unnest(['/_', '/_/k', '/_/k']) AS path, unnest([NULL, NULL, json_extract_string(props, '$.k')]) AS value FROM events")
def json_tree_shred(spark, sf_dir):
    return readers.nodes(_t(spark, sf_dir, "events"), "props", "event_id", kind="json").select("doc_id", "pre", "post", "path", "value")


@query("""SELECT event_id AS doc_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS text FROM events""")
def json_roundtrip(spark, sf_dir):
    return replace(_events(spark, sf_dir), kept=()).render("json")



@query("SELECT n_regionkey AS doc_id, n_name AS value, count(*) OVER (PARTITION BY n_regionkey) AS same_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS index FROM nation")
def json_dup_names(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit('"n":"'), x["n_name"], F.lit('"'))), ",")
    docs = n.groupBy("n_regionkey").agg(F.concat(F.lit("{"), items, F.lit("}")).alias("t"))
    nodes = readers.stored(readers.nodes(docs, "t", "n_regionkey", kind="json"), _scratch(spark))
    return xpath_frames.string_values(measure.sibling_index(nodes).filter("name = 'n'").select(*nodes.columns, "same_name", "index"), nodes).select("doc_id", F.col("text").alias("value"), "same_name", _long("index").alias("index"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS text FROM nation""")
def row_to_json(spark, sf_dir):
    return _nations(spark, sf_dir).render("json")



@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '<_><n_nationkey>' || n_nationkey || '</n_nationkey><n_name>' || n_name || '</n_name><n_regionkey>' || n_regionkey || '</n_regionkey></_>' AS text FROM nation")
def row_to_xml(spark, sf_dir):
    return _nations(spark, sf_dir).render("xml", declaration=False)



_VALUE = "CASE WHEN regexp_matches(n_name, '^[^\\s(){}''\"]+$') THEN n_name || ' ' ELSE '''' || n_name || '''' END"


@query(f"SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '_{{n_nationkey=' || n_nationkey || ' n_name=' || {_VALUE} || 'n_regionkey=' || n_regionkey || '}}' AS text FROM nation")
def row_to_brace(spark, sf_dir):
    return _nations(spark, sf_dir).render("brace", compact=True)



@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, unnest(['/_/n_nationkey="' || n_nationkey || '"', '/_/n_name="' || n_name || '"', '/_/n_regionkey="' || n_regionkey || '"']) AS line FROM nation""")
def row_to_clines(spark, sf_dir):
    return _nations(spark, sf_dir).clines().select("doc_id", "line")



@query("SELECT o_orderkey AS doc_id, CAST(3 AS BIGINT) AS n FROM orders")
def clines_leaf_count(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderpriority")).alias("t"))
    return trees.of(o, "t", "o_orderkey", kind="json").clines().groupBy("doc_id").agg(F.count("*").alias("n"))



@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def text_lines(spark, sf_dir):
    return readers.split_lines(_t(spark, sf_dir, "documents"), "text").select("doc_id", "line")



@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 10 GROUP BY 1")
def lines_stream(spark, sf_dir):
    """The events as lines of a text table, read as a stream until all are through."""
    at = _scratch(spark)
    _t(spark, sf_dir, "events").select(F.concat_ws("\t", "event_type", "props").alias("value")).write.text(f"{at}/in")

    def make(df: DataFrame) -> DataFrame:
        lines = df.select(F.lit(0).alias("doc_id"), F.substring_index("value", "\t", 1).alias("event_type"), F.substring_index("value", "\t", -1).alias("props"))
        found = trees.of(lines, "props", kind="json", keep=["event_type"]).first("/_/k")
        return found.select("event_type", measure.c_integer(F.col("value")).alias("k")).filter("k > 10")

    streams.table(streams.read(spark, f"{at}/in"), make, f"{at}/out", f"{at}/log").awaitTermination()
    return spark.read.schema("event_type string, k long").parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


# -- pages


@query("SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, sf_dir):
    return _page_trees(spark, sf_dir).values("//a/@href").withColumnRenamed("value", "href")



_DECODE = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query(f"SELECT page_id AS doc_id, trim({_DECODE.format(chr(114) + 'egexp_extract(html, ' + chr(39) + '<title>([^<]*)</title>' + chr(39) + ', 1)')}) AS title FROM pages")
def html_title(spark, sf_dir):
    return _page_trees(spark, sf_dir).first("/html/head/title").select("doc_id", F.trim("value").alias("title"))



@query("SELECT page_id AS doc_id, CAST(len(regexp_extract_all(html, '<li[ >]')) AS BIGINT) AS items, CAST(0 AS BIGINT) AS scripts FROM pages")
def html_delete_script(spark, sf_dir):
    left = _page_trees(spark, sf_dir).delete("//script")
    counts = left.each(lambda doc: [(sum(n.name == "li" for n in doc.walk() if n.kind == "element"), sum(n.name == "script" for n in doc.walk() if n.kind == "element"))], "items long, scripts long")
    return counts



@query("SELECT page_id AS doc_id, CAST(1 AS BIGINT) AS num_comments, CAST(strlen(trim(regexp_extract(html, '<!--(.*?)-->', 1))) AS BIGINT) AS size_comments FROM pages")
def html_comment_stats(spark, sf_dir):
    return measure.statistics(_pages(spark, sf_dir)).select("doc_id", "num_comments", "size_comments")


@query("SELECT page_id AS doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(html, '<{t}[ >]')) AS BIGINT) AS n_{t}" for t in ("a", "li", "article", "footer", "p", "b")) + " FROM pages")
def html_element_counts(spark, sf_dir):
    element = _pages(spark, sf_dir).filter("kind = 'element'")
    return element.groupBy("doc_id").agg(*[F.count_if(F.col("name") == t).alias(f"n_{t}") for t in ("a", "li", "article", "footer", "p", "b")])


# -- XPath


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(4 AS BIGINT) AS num_elements, CAST(34 AS BIGINT) AS size_element_names, CAST(3 AS BIGINT) AS num_text_nodes,
CAST(strlen(n_name) + strlen(CAST(n_nationkey AS VARCHAR)) + strlen(CAST(n_regionkey AS VARCHAR)) AS BIGINT) AS size_text_nodes, CAST(34 AS BIGINT) AS sum_meta FROM nation""")
def xml_statistics(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(_long("n_nationkey").alias("doc_id"), F.concat(F.lit("<nation><n_nationkey>"), "n_nationkey", F.lit("</n_nationkey><n_name>"), "n_name", F.lit("</n_name><n_regionkey>"), "n_regionkey", F.lit("</n_regionkey></nation>")).alias("t"))
    s = pipeline.statistics(n, "t", kind="xml")
    return s.select("doc_id", "num_elements", "size_element_names", "num_text_nodes", "size_text_nodes", "sum_meta")


#: Paths that are evaluated over tables of nodes; all others in one pass over trees.
_OVER_NODES = {"xpath_child", "xpath_descendant"}


def _ids(name: str, path: str):
    """The customer ids that a path to attributes gives."""
    if name in _OVER_NODES:
        return lambda spark, sf_dir: xpath_frames.select(_customers(spark, sf_dir), path).select("doc_id", F.col("value").cast("long").alias("id"))
    return lambda spark, sf_dir: _customer_trees(spark, sf_dir).values(path).select("doc_id", F.col("value").cast("long").alias("id"))


_BAL = "CAST(floor(c_acctbal) AS BIGINT)"
_C = "SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_custkey AS id FROM customer"
for _name, _path, _sql in (
    ("xpath_child", "/nation/customer/@id", _C),
    ("xpath_descendant", "//customer/@id", _C),
    ("xpath_attribute", "//customer[@seg='BUILDING']/@id", f"{_C} WHERE c_mktsegment = 'BUILDING'"),
    ("xpath_predicate", "/nation/customer[bal > 5000]/@id", f"{_C} WHERE {_BAL} > 5000"),
    ("xpath_not", "/nation/customer[not(@seg='BUILDING') and bal <= 0]/@id", f"{_C} WHERE c_mktsegment <> 'BUILDING' AND {_BAL} <= 0"),
    ("xpath_position", "/nation/customer[position() <= 2]/@id", "SELECT doc_id, id FROM (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r <= 2"),
    ("xpath_last", "/nation/customer[last()]/@id", "SELECT CAST(c_nationkey AS BIGINT) AS doc_id, max(c_custkey) AS id FROM customer GROUP BY 1"),
    ("xpath_union", "//customer[@seg='BUILDING']/@id | //customer[bal > 9000]/@id", f"{_C} WHERE c_mktsegment = 'BUILDING' OR {_BAL} > 9000"),
    ("xpath_following_sibling", "/nation/customer[1]/following-sibling::customer/@id", "SELECT doc_id, id FROM (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r > 1"),
    ("xpath_ancestor", "//bal[. > 9000]/ancestor::customer/@id", f"{_C} WHERE {_BAL} > 9000"),
):
    QUERIES[_name] = _ids(_name, _path)
    SQL[_name] = _sql


@query("SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(count(*) AS DOUBLE) AS value FROM customer GROUP BY 1")
def xpath_count(spark, sf_dir):
    return _customer_trees(spark, sf_dir).evaluate("count(/nation/customer)", "double")



@query(f"SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(sum({_BAL}) AS DOUBLE) AS value FROM customer GROUP BY 1")
def xpath_sum(spark, sf_dir):
    return _customer_trees(spark, sf_dir).evaluate("sum(//bal)", "double")



@query("""SELECT p_partkey AS doc_id, p_name || '/' || substr(p_name, 2, 5) || '/' || replace(p_name, 'a', '4') || '/' || length(p_name) || '/' || CASE WHEN starts_with(p_name, 'b') THEN 'true' ELSE 'false' END AS value FROM part""")
def xpath_string_functions(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.to_json(F.struct(F.col("p_name").alias("n"))).alias("t"))
    return trees.of(p, "t", kind="json").evaluate("concat(/_/n, '/', substring(/_/n, 2, 5), '/', translate(/_/n, 'a', '4'), '/', string-length(/_/n), '/', string(starts-with(/_/n, 'b')))")


# -- changes


def _changed(change: Callable[[Trees], Trees]) -> Query:
    return lambda spark, sf_dir: change(trees.of(_nation_brace(spark, sf_dir), "t", kind="brace")).render("json")


_J = "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, {} AS text FROM nation"
_KEY, _REGION, _NAME = "'\"n_nationkey\":' || n_nationkey", "'\"n_regionkey\":' || n_regionkey", "'\"n_name\":\"' || n_name || '\"'"
for _name, _change, _sql in (
    ("delete_xpath", lambda t: t.delete("//n_name"), f"'{{\"_\":\"nation\",' || {_KEY} || ',' || {_REGION} || '}}'"),
    ("replace_xpath", lambda t: t.replace_argument("/nation/n_name=gone"), f"'{{\"_\":\"nation\",' || {_KEY} || ',\"n_name\":\"gone\",' || {_REGION} || '}}'"),
    ("add_root", lambda t: t.add_root("top"), f"'{{\"_\":\"top\",\"nation\":{{' || {_KEY} || ',' || {_NAME} || ',' || {_REGION} || '}}}}'"),
    ("add_snippet", lambda t: t.add("extra{k=1}").select("/extra"), "'{\"_\":\"extra\",\"k\":1}'"),
    ("set_attribute", lambda t: t.delete("/nation/*[2]").set_attribute("/nation", "v", "1"), f"'{{\"_\":\"nation\",\"_v\":\"1\",' || {_KEY} || ',' || {_REGION} || '}}'"),
    ("select_reverse", lambda t: t.select("/nation/n_nationkey | /nation/n_regionkey").add_root("r"), f"'{{\"_\":\"r\",' || {_REGION} || ',' || {_KEY} || '}}'"),
):
    QUERIES[_name] = _changed(_change)
    SQL[_name] = _J.format(_sql)


def _entities(spark, sf_dir) -> Trees:
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("p{'Dear '&name;', '&#65;"), F.col("c_custkey"), F.lit("}")).alias("t"))
    return trees.of(c.withColumn("t", F.regexp_replace("t", "&#65;([0-9]+)", "&#65;'$1'")), "t", kind="brace", merge=False)


@query("SELECT c_custkey AS doc_id, 'Dear you, <ENTITY>#65' || c_custkey AS text FROM customer")
def entity_replace(spark, sf_dir):
    return _entities(spark, sf_dir).replace_entity("name", "you").render("text")



@query("SELECT c_custkey AS doc_id, 'Dear , <ENTITY>#65' || c_custkey AS text FROM customer")
def entity_delete(spark, sf_dir):
    return _entities(spark, sf_dir).delete_entity("name").render("text")



@query("SELECT c_custkey AS doc_id, 'Dear <ENTITY>name, A' || c_custkey AS text FROM customer")
def char_entity(spark, sf_dir):
    return _entities(spark, sf_dir).substitute_entity().render("text")



@query("SELECT c_custkey AS doc_id, 'Dear ab, <ENTITY>#65' || c_custkey AS text FROM customer")
def entity_replace_tree(spark, sf_dir):
    return _entities(spark, sf_dir).replace_entity_with_tree("name", "q{x=a y=b}").render("text")



@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, i - 1 AS line_no, CAST(coalesce(sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM l""")
def annotate_offsets(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    rows = d.select("doc_id", F.col("line_no").alias("pre"), F.lit("text").alias("kind"), "value")
    return mutate.annotate_offsets(rows).select("doc_id", _long("pre").alias("line_no"), "offset")


# -- functions


@query("""SELECT doc_id, '"' || replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t') || '"' AS quoted FROM documents""")
def quote_c(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('"'), T.quote_c(F.col("text")), F.lit('"')).alias("quoted"))


@query("SELECT conv_id, turn, replace(text, '\\', '') AS text FROM conversations")
def unquote_c(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.unquote_c(F.concat(F.lit('"'), T.quote_c(F.col("text")), F.lit('"'))).alias("text"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def bytes_vs_chars(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.byte_length(F.col("text")).alias("n_bytes"), T.char_length(F.col("text")).alias("n_chars"))


@query("SELECT s_suppkey AS doc_id, 'NAME=' || s_name || ' NATION=' || s_nationkey AS line FROM supplier")
def foreach_template(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct("s_name", "s_nationkey")).alias("t"))
    return trees.of(s, "t", "s_suppkey", kind="json").foreach("/_", "NAME=${s_name} NATION=${s_nationkey}").select("doc_id", "line")


@query("SELECT p_partkey AS doc_id, CAST(p_size AS BIGINT) AS value FROM part")
def get_int_octal_hex(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    shown = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("0x"), F.hex("p_size"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("0"), F.conv(F.col("p_size").cast("string"), 10, 8))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" pieces")))
    docs = p.select("p_partkey", F.to_json(F.struct(shown.alias("s"))).alias("t"))
    return trees.of(docs, "t", "p_partkey", kind="json").first("/_/s").withColumn("value", measure.c_integer(F.col("value")))


@query("SELECT n_name AS name, replace(n_name, ' ', '_') AS safe FROM nation")
def safe_name(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), T.safe_name(F.col("n_name")).alias("safe"))


# -- grammars


def _table(sep: str, quote: bool, grammar: str):
    def run(spark, sf_dir):
        n = _t(spark, sf_dir, "nation")
        name = F.concat(F.lit('"'), "n_name", F.lit('"')) if quote else F.col("n_name")
        line = F.concat_ws(sep, "n_nationkey", name, "n_regionkey")
        docs = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))
        rows = trees.parsed(docs, "t", grammar, "n_regionkey").each(lambda doc: ([c.text() for c in r.children] for r in doc.children[0].children), "n_nationkey string, n_name string, n_regionkey string")
        return rows.select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))

    return run


for _name, _sep, _quote, _grammar in (("ixml_csv", ",", True, "ixml:data/csv"), ("ixml_tsv", "\t", False, "ixml:data/tsv")):
    QUERIES[_name] = _table(_sep, _quote, _grammar)
    SQL[_name] = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query("SELECT page_id AS doc_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def ixml_url(spark, sf_dir):
    return trees.parsed(_t(spark, sf_dir, "pages"), "url", "ixml:data/url", "page_id").each(lambda doc: [_parts(doc.children[0], "scheme", "host", "path")], "scheme string, host string, path string")


def _parts(n, *names: str) -> tuple[str, ...]:
    """The texts of an element's children by name."""
    found = {c.name: c.text() for c in n.children if c.kind == "element"}
    return tuple(found.get(name, "") for name in names)


@query("SELECT o_orderkey AS doc_id, split_part(o_orderpriority, '-', 1) AS level, split_part(o_orderpriority, '-', 2) || '!' AS name FROM orders")
def ixml_insertion_attr(spark, sf_dir):
    grammar = "p = @level, -'-', name. level = ['0'-'9']+. name = ~[]+, +'!'."
    found = trees.parsed(_t(spark, sf_dir, "orders"), "o_orderpriority", grammar, "o_orderkey")
    return found.each(lambda doc: [(doc.children[0].attr("level").text(), doc.children[0].children[0].text())], "level string, name string")


@query("SELECT p_partkey AS doc_id, NOT starts_with(p_name, 'part 1') AS parsed FROM part")
def ixml_not_lookahead(spark, sf_dir):
    return trees.parsed(_t(spark, sf_dir, "part"), "p_name", "n = !'part 1', ~[]*.", "p_partkey").each(lambda doc: [(doc.children[0].name == "n",)], "parsed boolean")



@query("SELECT page_id AS doc_id, NOT regexp_matches(url, '^[a-z0-9:/._-]*$') AS failed FROM pages")
def ixml_failed(spark, sf_dir):
    return trees.parsed(_t(spark, sf_dir, "pages"), "url", "u = ['a'-'z'; '0'-'9'; ':/._-']*.", "page_id").each(lambda doc: [(doc.children[0].name == "ixml",)], "failed boolean")



@query("SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 'B' AS cheapest, 'ambiguous' AS state FROM region")
def ixml_ambiguous_cost(spark, sf_dir):
    r = _t(spark, sf_dir, "region")
    cheap = registry.nodes(r, "r_name", "S = A | B. A =< ~[]+. B = ~[]+.", "r_regionkey").filter("level = 1").select("doc_id", F.col("name").alias("cheapest"))
    both = registry.nodes(r, "r_name", "S = A | B. A = ~[]+. B = ~[]+.", "r_regionkey").filter("kind = 'attribute'").select("doc_id", F.col("value").alias("state"))
    return cheap.join(both, "doc_id")


# -- brace syntax


@query("SELECT unnest(['element_name', 'brace_left', 'brace_right', 'element_key', 'equals', 'element_value_text', 'element_value_quote', 'whitespace']) AS kind, unnest([n, n, n, 3 * n, 3 * n, 2 * n, n, n]) AS n FROM (SELECT count(*) AS n FROM nation)")
def tokenize_brace(spark, sf_dir):
    from .sources import tokens

    return tokens.tokenize(_nation_brace(spark, sf_dir), "t").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'nation{{n_nationkey=' || n_nationkey || ' n_name=' || {_VALUE} || 'n_regionkey=' || n_regionkey || '}}' AS text FROM nation")
def brace_roundtrip(spark, sf_dir):
    return trees.of(_nation_brace(spark, sf_dir), "t", kind="brace").render("brace", compact=True)



# -- stylesheets and schemas

_SHEET = "xsl:stylesheet(version = 1.0 xmlns:xsl = http://www.w3.org/1999/XSL/Transform) {{ {} }}"


@query("""SELECT CAST(c_nationkey AS BIGINT) AS doc_id, string_agg(c_custkey || ';', '' ORDER BY CAST(floor(c_acctbal) AS BIGINT) DESC, c_custkey) AS text FROM customer GROUP BY 1""")
def xslt_foreach_sort(spark, sf_dir):
    sheet = _SHEET.format("xsl:template(match = /nation) { out { xsl:for-each(select = customer) { xsl:sort(select = bal data-type = number order = descending) xsl:sort(select = @id data-type = number) xsl:value-of(select = @id) ';' } } }")
    return _customer_trees(spark, sf_dir).transform(sheet).render("text")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name || ' in ' || r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def xslt_lookup_join(spark, sf_dir):
    regions = _t(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # the second document: five rows
    other = "regions {" + " ".join(f"r(k = {r.r_regionkey}) = '{r.r_name}'" for r in regions) + "}"
    sheet = _SHEET.format("xsl:template(match = /nation) { out { xsl:variable(name = k select = n_regionkey) xsl:value-of(select = n_name) ' in ' xsl:value-of(select = \"document('r')/regions/r[@k=$k]\") } }")
    return trees.of(_nation_brace(spark, sf_dir), "t", kind="brace").transform(sheet, documents={"r": other}).render("text")


@query("SELECT doc_id, string_agg(seg || '=' || n || ';', '' ORDER BY seg) AS text FROM (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY ALL) GROUP BY 1")
def xslt_group(spark, sf_dir):
    sheet = _SHEET.format("xsl:key(name = s match = customer use = @seg) xsl:template(match = /nation) { out { xsl:for-each(select = \"customer[generate-id() = generate-id(key('s', @seg)[1])]\") { xsl:sort(select = @seg) xsl:value-of(select = @seg) '=' xsl:value-of(select = \"count(key('s', @seg))\") ';' } } }")
    return _customer_trees(spark, sf_dir).transform(sheet).render("text")


_SCHEMA = "xs:schema(xmlns:xs = http://www.w3.org/2001/XMLSchema) {{ xs:element(name = _) {{ xs:complexType {{ xs:sequence {{ {} }} }} }} {} }}"


@query("SELECT event_id AS doc_id, CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 50 AS valid FROM events")
def validate_int(spark, sf_dir):
    schema = _SCHEMA.format("xs:element(name = k type = K)", "xs:simpleType(name = K) { xs:restriction(base = xs:int) { xs:minInclusive(value = 10) xs:maxInclusive(value = 50) } }")
    return replace(_events(spark, sf_dir), kept=()).validate(schema).select("doc_id", "valid")


@query("SELECT o_orderkey AS doc_id, o_orderstatus IN ('F', 'O') AS valid FROM orders")
def validate_enum(spark, sf_dir):
    schema = _SCHEMA.format("xs:element(name = s type = K)", "xs:simpleType(name = K) { xs:restriction(base = xs:string) { xs:enumeration(value = F) xs:enumeration(value = O) } }")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("s"))).alias("t"))
    return trees.of(o, "t", "o_orderkey", kind="json").validate(schema).select("doc_id", "valid")


# -- what sources, sinks and functions give on their own


@query("SELECT 'brace' AS content_type, CAST(strlen(r_name) + 10 AS BIGINT) AS size_source, r_name AS name FROM region")
def load_files(spark, sf_dir):
    """A file for each region, read whole."""
    at = _scratch(spark)
    _t(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("r{n='"), "r_name", F.lit("'  }")).alias("value")).write.partitionBy("r_regionkey").text(at)
    docs = readers.files(spark, f"{at}/*/*.txt")
    return trees.of(docs, "raw", keep=["content_type", "size_source"]).first("/r/n").select("content_type", "size_source", F.col("value").alias("name"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def read_lines(spark, sf_dir):
    """Lines of text files, each a document."""
    at = _scratch(spark)
    _t(spark, sf_dir, "events").select(F.col("props").alias("value")).write.text(at)
    found = trees.of(readers.lines(spark, at), "raw").first("/_/k")
    return found.groupBy(measure.c_integer(F.col("value")).alias("k")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT 0 AS doc_id, 'json' AS content_type, '{"a":[1,2]}' AS raw UNION ALL SELECT 1, 'brace', 'b=2' UNION ALL SELECT 2, 'xml', '<c d="e"/>' UNION ALL SELECT 3, 'html', '<html></html>'),
t AS (SELECT type, sum(n) AS n FROM (%s UNION ALL %s) GROUP BY 1)
SELECT doc_id, content_type, raw, CAST(coalesce(n, 0) AS BIGINT) AS alike FROM d LEFT JOIN t ON type = content_type""" % (_DETECT.format(c="html", t="pages"), _DETECT.format(c="text", t="documents")))
def literal_docs(spark, sf_dir):
    """Documents given as texts, and how many of the pages and documents are of their types."""
    given = readers.literal(spark, '{"a":[1,2]}', "b=2", '<c d="e"/>', "<html></html>")
    texts = _t(spark, sf_dir, "pages").select("html").unionByName(_t(spark, sf_dir, "documents").select(F.col("text").alias("html")))
    types = texts.groupBy(detect.content_type(F.col("html")).alias("content_type")).agg(F.count("*").alias("n"))
    return given.join(types, "content_type", "left").select(F.col("doc_id").cast("int"), "content_type", "raw", F.coalesce("n", F.lit(0)).alias("alike"))


@query("SELECT 0 AS doc_id, 'brace' AS content_type, CAST(0 AS BIGINT) AS size_source, (SELECT count(*) FROM documents WHERE strlen(text) > 0) AS larger")
def empty_doc(spark, sf_dir):
    """A document without content, and how many of the documents have more."""
    sizes = readers.docs(_t(spark, sf_dir, "documents"), "text").groupBy("size_source").agg(F.count("*").alias("n")).withColumnRenamed("size_source", "size")
    found = readers.empty(spark).join(sizes, F.col("size") > F.col("size_source"), "left").groupBy("doc_id", "content_type", "size_source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("larger"))
    return found.select(F.col("doc_id").cast("int"), "content_type", "size_source", "larger")


def _parts_as(kind: str, **options):
    return lambda spark, sf_dir: trees.of(_t(spark, sf_dir, "part"), "p_name", "p_partkey", kind="text", **options).render(kind, **({"declaration": False} if kind == "xml" else {}))


QUERIES["text_kind"], SQL["text_kind"] = _parts_as("text"), "SELECT p_partkey AS doc_id, p_name AS text FROM part"
QUERIES["implicit_root"], SQL["implicit_root"] = _parts_as("xml", root="name"), "SELECT p_partkey AS doc_id, '<name>' || p_name || '</name>' AS text FROM part"


@query("SELECT p_partkey AS doc_id, p_name AS value FROM part")
def trim_xml(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<p>\n   "), "p_name", F.lit("\n  </p>")).alias("t"))
    return trees.of(p, "t", "p_partkey", kind="xml").values("/p")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'error' ELSE 'element' END AS kind FROM orders")
def forced_type(spark, sf_dir):
    """Texts that look like another kind than the one asked for aren't parsed."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.expr("if(o_orderkey % 3 = 0, 'a=1', '<a>1</a>')").alias("t"))
    return trees.of(o, "t", "o_orderkey", kind="xml", forced=True).each(lambda doc: [(doc.children[0].kind,)], "kind string")


@query("SELECT CAST(c_nationkey AS BIGINT) AS doc_id, string_agg('<id>' || c_custkey || '</id>', '' ORDER BY c_custkey) AS text FROM customer GROUP BY 1")
def select_attributes(spark, sf_dir):
    return _customer_trees(spark, sf_dir).select("//@id", "document").render("xml", declaration=False)


@query(f"SELECT CAST(c_nationkey AS BIGINT) AS doc_id, {_BAL} AS bal FROM customer WHERE c_mktsegment = 'BUILDING'")
def relative_path(spark, sf_dir):
    """A relative path from the rows of another one."""
    nodes = readers.stored(_customers(spark, sf_dir), _scratch(spark))
    bal = xpath_frames.select(nodes, "bal", xpath_frames.select(nodes, "/nation/customer[@seg='BUILDING']"))
    return xpath_frames.string_values(bal, nodes).select("doc_id", F.col("text").cast("long").alias("bal"))


@query("SELECT doc_id, id, CASE WHEN n > 1 THEN 'TooMany' END AS error FROM (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_custkey AS id, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)")
def single_match(spark, sf_dir):
    return measure.single(_customers(spark, sf_dir), "/nation/customer/@id").select("doc_id", F.col("value").cast("long").alias("id"), "error")


@query("SELECT p_partkey AS doc_id, p_name || ' < ' || p_size AS text FROM part")
def entity_named(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p{'"), "p_name", F.lit(" '&lt;' "), "p_size", F.lit("'}")).alias("t"))
    return trees.of(p, "t", "p_partkey", kind="brace", merge=False).substitute_entity("lt").render("text")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '<nation><n>' || n_nationkey || '</n></nation><extra k="1">x<y></y></extra>' AS text FROM nation""")
def add_built_tree(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(_long("n_nationkey").alias("doc_id"), F.concat(F.lit("nation{n="), "n_nationkey", F.lit("}")).alias("t"))
    extra = model.document(model.element("extra", model.text("x"), model.element("y"), k="1"))
    return trees.of(n, "t", kind="brace").add(extra).render("html")


_PRETTY = f"'nation {{' || chr(10) || '    n_nationkey = ' || n_nationkey || chr(10) || '    n_name      = ' || rtrim({_VALUE}) || chr(10) || '    n_regionkey = ' || n_regionkey || chr(10) || '}}' || chr(10)"


@query(f"SELECT CAST(n_nationkey AS BIGINT) AS doc_id, {_PRETTY} AS text FROM nation")
def brace_pretty(spark, sf_dir):
    return trees.of(_nation_brace(spark, sf_dir), "t", kind="brace").render("brace")


@query(f"SELECT CAST(n_nationkey AS BIGINT) AS doc_id, {_PRETTY} AS text, CAST(7 AS BIGINT) AS named FROM nation")
def brace_coloured(spark, sf_dir):
    """The same in colours for HTML: without its marks, the text is that of ``brace_pretty``."""
    show = writers.renderer("brace")
    painted = trees.of(_nation_brace(spark, sf_dir), "t", kind="brace").each(lambda doc: [(coloured.paint(show(doc), "html"),)], "painted string")
    plain = F.regexp_replace("painted", "<[^>]*>", "")
    return painted.select("doc_id", plain.alias("text"), F.regexp_count("painted", F.lit('class="')).cast("long").alias("named"))


@query("SELECT doc_id, CASE WHEN n = 1 THEN 3 ELSE n + 1 END AS quotes FROM (SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(text, '''+'), lambda x: len(x))), 0) AS n FROM documents)")
def quotes_around(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.quotes_needed(F.col("text")).alias("quotes"))


@query("""SELECT doc_id, length(b) - length(replace(b, chr(10), '')) + 1 AS line, length(regexp_extract(b, '[^\n]*$')) + 1 AS col FROM (SELECT doc_id, substr(text, 1, CAST(length(text) // 2 AS INT)) AS b FROM documents)""")
def line_and_column(spark, sf_dir):
    at = F.expr("cast(char_length(text) div 2 as int)")
    return _t(spark, sf_dir, "documents").select("doc_id", T.line_of(F.col("text"), at).alias("line"), T.column_of(F.col("text"), at).alias("col"))


@query("SELECT word, regexp_full_match(word, '-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][+-]?[0-9]+)?') AS number, word IN ('true', 'false', 'null') AS keyword, regexp_full_match(word, '[A-Za-z_][A-Za-z0-9_.:#-]*') AS name, regexp_full_match(substr(word, 1, 1), '\\p{Lu}') AS upper FROM (SELECT DISTINCT unnest([n_name, CAST(n_nationkey AS VARCHAR), '0' || n_nationkey, n_nationkey || '.5e3', 'true', 'a:b', '-1']) AS word FROM nation)")
def kinds_of_words(spark, sf_dir):
    n = F.col("n_nationkey").cast("string")
    words = _t(spark, sf_dir, "nation").select(F.explode(F.array("n_name", n, F.concat(F.lit("0"), n), F.concat(n, F.lit(".5e3")), F.lit("true"), F.lit("a:b"), F.lit("-1"))).alias("word")).distinct()
    w = F.col("word")
    return words.select("word", T.is_json_number(w).alias("number"), T.is_json_keyword(w).alias("keyword"), T.is_name(w).alias("name"), T.in_category(F.substring(w, 1, 1), "Lu").alias("upper"))


@query("""SELECT p_partkey AS doc_id, name, CASE p_partkey % 4 WHEN 0 THEN chr(CAST(33 + p_size AS INT)) WHEN 1 THEN chr(CAST(192 + p_size AS INT)) WHEN 2 THEN '"' END AS char
FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN '#' || (33 + p_size) WHEN 1 THEN '#x' || lower(hex(192 + p_size)) WHEN 2 THEN 'quot' ELSE 'nothing' || p_size END AS name FROM part)""")
def entity_chars(spark, sf_dir):
    """Characters by decimal and hexadecimal numbers and by name."""
    by = F.col("p_partkey") % 4
    name = F.when(by == 0, F.concat(F.lit("#"), 33 + F.col("p_size"))).when(by == 1, F.concat(F.lit("#x"), F.lower(F.hex(192 + F.col("p_size"))))).when(by == 2, "quot").otherwise(F.concat(F.lit("nothing"), "p_size"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), name.alias("name"), T.entity_char(name).alias("char"))


@query("""SELECT p_partkey AS doc_id, replace(p_name, ' ', '-' || chr(9232) || '-') || '-' || chr(9232) AS escaped, replace(p_name, ' ', '--') || '-' AS back, '''' || p_name || '''' AS quoted, p_name || chr(10) || '  x' AS trimmed FROM part""")
def text_functions(spark, sf_dir):
    name = F.col("p_name")
    comment = F.concat(F.replace(name, F.lit(" "), F.lit("--")), F.lit("-"))
    indented = F.concat(F.lit("\n    "), name, F.lit("\n      x\n    "))
    escaped = T.escape_comment(comment)
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), escaped.alias("escaped"), T.unescape_comment(escaped).alias("back"), T.quote_compact(name).alias("quoted"), T.trim_quote(indented).alias("trimmed"))


# -- more of grammars, stylesheets and schemas


@query("SELECT p_partkey AS doc_id, 'B' AS cheapest FROM part")
def ixml_cost_long(spark, sf_dir):
    """The only cheap parse splits a text of over 80 characters at its start; 80 other splits come before it."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("x"), F.rpad("p_name", 80, "y")).alias("t"))
    found = trees.parsed(p, "t", "S = A, B. A = ~[]*. B = 'x', ~[]* | C. C =< ~[]*.", "p_partkey")
    return found.each(lambda doc: [("C" if any(n.name == "C" for n in doc.walk()) else "B",)], "cheapest string")


@query("SELECT n_nationkey AS doc_id, CAST(length(n_name) + 1 AS BIGINT) AS parses FROM nation")
def ixml_all_parses(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(_long("n_nationkey").alias("doc_id"), "n_name")
    found = trees.parsed(n, "n_name", "S = A, B. A = ~[]*. B = ~[]*.", every=True).each(lambda doc: [(sum(c.name == "S" for c in doc.children[0].children),)], "parses long")
    return found.select(F.col("doc_id").cast("int"), "parses")


@query("SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) || o_custkey AS kept, CAST(3 + length(o_orderstatus) AS BIGINT) AS skipped FROM orders")
def ixml_recover(spark, sf_dir):
    """Numbers with other characters among them, parsed without as few characters as may be."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("!"), "o_orderkey", F.lit("?"), "o_orderstatus", "o_custkey", F.lit("!")).alias("t"))
    found = trees.parsed(o, "t", "n = ['0'-'9']+.", "o_orderkey", recover=True)
    return found.each(lambda doc: [(doc.children[0].text(), int(doc.children[0].attr("skipped").text()))], "kept string, skipped long")


@query("SELECT s_suppkey AS doc_id, CAST(s_suppkey % 60 AS VARCHAR) AS minute, s_name AS command, CAST(s_nationkey AS VARCHAR) AS value FROM supplier")
def ixml_crontab(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("# suppliers\nNATION = "), "s_nationkey", F.lit("\n"), F.col("s_suppkey") % 60, F.lit(" 4 * * 1 "), "s_name").alias("t"))
    return trees.parsed(s, "t", "ixml:conf/crontab", "s_suppkey").each(lambda doc: [tuple(xpath_tree.string(xpath_tree.evaluate(e, xpath_tree.Context(doc))) for e in _CRON)], "minute string, command string, value string")


_CRON = [xpath.parse(x) for x in ("/crontab/line/minute", "/crontab/line/command", "/crontab/variable[name='NATION']/value")]


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def ixml_yaml(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(_long("n_nationkey").alias("doc_id"), F.concat(F.lit("nation:\n  name: '"), "n_name", F.lit("'\n  in:\n    - part: a\n      key: "), "n_regionkey", F.lit("\n    - b\nend: 1\n")).alias("t"))
    found = [xpath.parse(x) for x in ("/_/obj[@key='nation']/kv[@key='name']", "/_/obj/obj[@key='in']/list/li[1]/kv[@key='key']")]
    return trees.parsed(n, "t", "ixml:conf/yamlsubset").each(lambda doc: [tuple(xpath_tree.string(xpath_tree.evaluate(e, xpath_tree.Context(doc))) for e in found)], "name string, region string")


@query("SELECT o_orderkey AS doc_id, lpad(CAST(o_orderkey % 31 AS VARCHAR), 2, '0') AS month, CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END || lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0') AS air, 'rain' AS weather FROM orders")
def ixml_metar(spark, sf_dir):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    t = F.concat(F.lit("METAR ESSA "), two(F.col("o_orderkey") % 31), F.lit("1620Z 12012MPS 9999 -RA "), F.when(F.col("o_orderkey") % 2 == 0, "M").otherwise(""), two(F.col("o_custkey") % 40), F.lit("/05 Q1020="))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"))
    found = [xpath.parse(f"/weather_report/{x}") for x in ("time_of_observation/month", "temperature/air_c", "weather/observation/type-info")]
    return trees.parsed(o, "t", "ixml:measurement/metar", "o_orderkey").each(lambda doc: [tuple(xpath_tree.string(xpath_tree.evaluate(e, xpath_tree.Context(doc))) for e in found)], "month string, air string, weather string")


@query("SELECT CAST(c_nationkey AS BIGINT) AS doc_id, string_agg(c_custkey || ':' || replace(replace(format('{:,}', CAST(floor(c_acctbal) AS BIGINT)), ',', '.'), '-', '~') || ';', '' ORDER BY c_custkey) || count(*) AS text FROM customer GROUP BY 1")
def xslt_import_format(spark, sf_dir):
    """A stylesheet that imports another, with a decimal format of its own and a parameter that is an expression."""
    base = _SHEET.format("xsl:template(match = customer) { xsl:value-of(select = @id) }")
    sheet = _SHEET.format("xsl:import(href = base) xsl:decimal-format(name = d grouping-separator = '.' decimal-separator = ',' minus-sign = '~') xsl:param(name = n) xsl:template(match = /nation) { out { xsl:apply-templates(select = customer) xsl:value-of(select = $n) } } xsl:template(match = customer) { xsl:apply-imports ':' xsl:value-of(select = \"format-number(bal, '#.##0', 'd')\") ';' }")
    return _customer_trees(spark, sf_dir).transform(sheet, params={"n": xslt.Expression("count(/nation/customer)")}, documents={"base": base}).render("text")


@query("SELECT o_orderkey AS doc_id, o_orderkey % 3 <> 0 AS valid FROM orders")
def validate_key(spark, sf_dir):
    """Keys of a schema: every third document has a key twice."""
    schema = "xs:schema(xmlns:xs = http://www.w3.org/2001/XMLSchema) { xs:element(name = r) { xs:complexType { xs:sequence { xs:element(name = s maxOccurs = unbounded type = xs:int) } } xs:key(name = k) { xs:selector(xpath = s) xs:field(xpath = '.') } } }"
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("r{s=1 s=2 s="), F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(3), F.lit("}")).alias("t"))
    return trees.of(o, "t", "o_orderkey", kind="brace").validate(schema).select("doc_id", "valid")
