"""Queries that run on stored tables of nodes: expressions and changes as joins, windows and filters, with no Python behind the parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import tables
from .functions.numbering import running
from .grammar import regular
from .model import NODES
from .operators import measure, mutate
from .plans import lookup, schema_frames, summary, twig, xpath_frames, xsd
from .queries import QUERIES, SQL, _nation_json, _scratch, _t, query
from .sinks import streamed, writers
from .sources import brace, chunked, readers

# -- one document of all orders


def _ledger(spark, sf_dir) -> DataFrame:
    """One document: orders by key, elements named by their status, with an attribute id; in them their lines, named by their flag, with text key:line. Stored.

    Numbers follow from the sizes of orders: those before an order are summed up over the orders alone, and what stands in an order is counted from its own number. So lines are
    shuffled once, by their order, and the nodes aren't sorted.
    """
    where = _scratch(spark)
    lines = _t(spark, sf_dir, "lineitem")
    counts = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    sized = o.join(counts.hint("merge"), "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sized.write.parquet(f"{where}/sized")
    sized = spark.read.schema(sized.schema).parquet(f"{where}/sized")
    sums = {"ord": F.lit(1).cast("long"), "above": 2 * F.col("n") + 2}
    orders = running(sized, sums, f"{where}/orders", F.asc("k")).withColumn("at", F.col("above") + 1)
    place = F.row_number().over(Window.partitionBy("k").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))  # line numbers may repeat
    placed = lines.withColumnRenamed("l_orderkey", "k").filter("k is not null").select("k", place.alias("line"), "l_returnflag", F.concat_ws(":", "k", "l_linenumber").alias("text"))
    # two nodes for each order and for each line: an element, and its attribute or text; a node's post is its number and its size less its level
    held = orders.withColumns({"sub": F.explode(F.array(F.lit(0), F.lit(1)))}).selectExpr(
        "at + sub pre", "if(sub = 0, at + 2 * n, at - 1) post", "if(sub = 0, 0, at) parent", "1 + sub level", "if(sub = 0, ord, 0) ord", "if(sub = 0, 'element', 'attribute') kind",
        "if(sub = 0, status, 'id') name", "if(sub = 0, null, string(k)) value", "'/orders/' || status || if(sub = 0, '', '/@id') path",
    )
    inner = placed.join(orders.select("k", "status", "at").hint("merge"), "k").withColumn("first", F.col("at") + 2 * F.col("line")).withColumns({"sub": F.explode(F.array(F.lit(0), F.lit(1)))}).selectExpr(
        "first + sub pre", "if(sub = 0, first - 1, first - 2) post", "if(sub = 0, at, first) parent", "2 + sub level", "if(sub = 0, line, 0) ord", "if(sub = 0, 'element', 'text') kind",
        "if(sub = 0, l_returnflag, null) name", "if(sub = 0, null, text) value", "'/orders/' || status || '/' || l_returnflag path",
    )
    root = sized.agg(F.coalesce(F.sum(sums["above"]), F.lit(0)).alias("n")).selectExpr("0L pre", "n post", "-1L parent", "0 level", "0L ord", "'element' kind", "'orders' name", "string(null) value", "'/orders' path")
    nodes = held.unionByName(inner).unionByName(root).withColumns({"doc_id": F.lit(0), "prefix": F.lit(None), "ns_uri": F.lit(None)})
    typed = [F.col(x.split()[0]).cast(x.split()[1]).alias(x.split()[0]) for x in NODES.split(", ")]
    return readers.stored(nodes.select(*typed), f"{where}/nodes")


_LINES = "SELECT l_orderkey || ':' || l_linenumber AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {}"


@query(_LINES.format("o_orderstatus = 'F' AND l_returnflag = 'R'"))
def huge_descendant(spark, sf_dir):
    nodes = _ledger(spark, sf_dir)
    found = xpath_frames.select(nodes, "//F/descendant::R")
    return xpath_frames.string_values(found, nodes).select(F.col("text").alias("line"))


@query("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND l_returnflag = 'A'")
def huge_ancestor(spark, sf_dir):
    return xpath_frames.select(_ledger(spark, sf_dir), "//A/ancestor::O/@id").select(F.col("value").alias("id"))


@query(_LINES.format("l_returnflag = 'N' AND o_orderkey > (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P')"))
def huge_following(spark, sf_dir):
    return xpath_frames.select(_ledger(spark, sf_dir), "/orders/P/following::N/text()").select(F.col("value").alias("line"))


# -- a document for each customer, stored by path


def _account_xml(spark, sf_dir) -> DataFrame:
    """A document for each customer with their balance in whole units and their orders by key.

    Orders are dealt by their customer to many tasks, which parse what they put together: by the size of its files a table would be few tasks, or sent through the driver.
    """
    c = _t(spark, sf_dir, "customer")
    o = readers.dealt(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"), "o_custkey")
    one = F.concat(F.lit('<order id="'), "o_orderkey", F.lit('" st="'), "o_orderstatus", F.lit('"><prio>'), F.substring("o_orderpriority", 1, 1), F.lit("</prio></order>"))
    orders = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("x")))), lambda x: x["x"]), "").alias("orders"))
    head = F.concat(F.lit('<customer id="'), "c_custkey", F.lit('" seg="'), "c_mktsegment", F.lit('"><bal>'), F.floor("c_acctbal"), F.lit("</bal>"))
    return c.join(orders.hint("merge"), c.c_custkey == orders.o_custkey, "left").select(F.col("c_custkey").alias("doc_id"), F.concat(head, F.coalesce("orders", F.lit("")), F.lit("</customer>")).alias("t"))


def _accounts(spark, sf_dir) -> DataFrame:
    return readers.stored(readers.nodes(_account_xml(spark, sf_dir), "t", kind="xml"), _scratch(spark))


def _account_store(spark, sf_dir) -> summary.Store:
    where = _scratch(spark)
    summary.store(readers.nodes(_account_xml(spark, sf_dir), "t", kind="xml"), where)
    return summary.Store(spark, where)


@query("""SELECT path, kind, n FROM (
SELECT '/customer' AS path, 'element' AS kind, count(*) AS n FROM customer UNION ALL SELECT '/customer/@id', 'attribute', count(*) FROM customer UNION ALL SELECT '/customer/@seg', 'attribute', count(*) FROM customer
UNION ALL SELECT '/customer/bal', k, count(*) FROM customer, (SELECT unnest(['element', 'text']) AS k) GROUP BY k
UNION ALL SELECT p, k, n FROM (SELECT count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey),
  (SELECT unnest(['/customer/order', '/customer/order/@id', '/customer/order/@st', '/customer/order/prio', '/customer/order/prio']) AS p, unnest(['element', 'attribute', 'attribute', 'element', 'text']) AS k)) WHERE n > 0""")
def path_summary(spark, sf_dir):
    return _account_store(spark, sf_dir).paths.select("path", "kind", "n")


_BAL = "CAST(floor(c_acctbal) AS BIGINT)"
_CO = "FROM customer JOIN orders ON c_custkey = o_custkey"
for _name, _path, _sql in (
    ("stored_attribute", "/customer/@id", "SELECT c_custkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer"),
    ("stored_predicate", "/customer[bal > 5000]/@seg", f"SELECT c_custkey AS doc_id, c_mktsegment AS value FROM customer WHERE {_BAL} > 5000"),
    ("stored_branches", "/customer[@seg='BUILDING' and order[@st='F']/prio=1]/order/@id", f"SELECT c_custkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS value {_CO} WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%')"),
    ("stored_not", "//customer[not(order)]/@id", "SELECT c_custkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    ("stored_position", "/customer/order[2]/@id", f"SELECT doc_id, value FROM (SELECT c_custkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r {_CO}) WHERE r = 2"),
    ("stored_last", "/customer/order[last()]/@id", f"SELECT c_custkey AS doc_id, CAST(max(o_orderkey) AS VARCHAR) AS value {_CO} GROUP BY 1"),
    ("stored_union", "//bal/text() | //order[@st='P']/@id", f"SELECT c_custkey AS doc_id, CAST({_BAL} AS VARCHAR) AS value FROM customer UNION ALL SELECT c_custkey, CAST(o_orderkey AS VARCHAR) {_CO} WHERE o_orderstatus = 'P'"),
    ("stored_sibling", "//order[@st='P']/following-sibling::order[@st='F']/@id", f"SELECT c_custkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS value {_CO} WHERE o_orderstatus = 'F' AND o_orderkey > (SELECT min(p.o_orderkey) FROM orders p WHERE p.o_custkey = c_custkey AND p.o_orderstatus = 'P')"),
    ("stored_ancestor", "//prio[. = 5]/ancestor::customer/@id", f"SELECT DISTINCT c_custkey AS doc_id, CAST(c_custkey AS VARCHAR) AS value {_CO} WHERE o_orderpriority LIKE '5%'"),
):
    QUERIES[_name] = lambda spark, sf_dir, path=_path: _account_store(spark, sf_dir).select(path).select("doc_id", "value")
    SQL[_name] = _sql


for _name, _path, _sql in (
    ("stored_count", "count(/customer/order)", "SELECT c_custkey AS doc_id, CAST(count(o_orderkey) AS DOUBLE) AS value FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    ("stored_sum", "sum(//prio)", "SELECT c_custkey AS doc_id, CAST(coalesce(sum(CAST(left(o_orderpriority, 1) AS DOUBLE)), 0) AS DOUBLE) AS value FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    ("stored_string", "concat(/customer/@seg, '-', substring(/customer/@seg, 2, 3), '-', string-length(/customer/bal))", f"SELECT c_custkey AS doc_id, c_mktsegment || '-' || substr(c_mktsegment, 2, 3) || '-' || length(CAST({_BAL} AS VARCHAR)) AS value FROM customer"),
):
    QUERIES[_name] = lambda spark, sf_dir, path=_path: _account_store(spark, sf_dir).evaluate(path)
    SQL[_name] = _sql


for _name, _path, _sql in (
    ("twig_branches", "/customer[@seg='BUILDING' and order[@st='F']/prio=1]/order/@id", SQL["stored_branches"]),
    ("twig_not", "//customer[bal > 0 and not(order/@st='P')]/order[prio < 3]/@id", f"SELECT c_custkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS value {_CO} WHERE {_BAL} > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND CAST(left(o_orderpriority, 1) AS INT) < 3"),
):
    QUERIES[_name] = lambda spark, sf_dir, path=_path: twig.match(_account_store(spark, sf_dir).pruned(path), path, _scratch(spark)).select("doc_id", "value")
    SQL[_name] = _sql


@query(_LINES.format("l_returnflag = 'N' AND o_orderstatus = 'O' AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"))
def twig_huge(spark, sf_dir):
    """In one document of all orders, whose root lies in all buckets."""
    return twig.match(_ledger(spark, sf_dir), "/orders[F]/O[A and not(R)]/N/text()", _scratch(spark)).select(F.col("value").alias("line"))


# -- changes on tables of nodes, shown as path lines


def _nations(spark, sf_dir) -> DataFrame:
    return readers.stored(readers.nodes(_nation_json(spark, sf_dir), "t", kind="json"), _scratch(spark))


def _lines(nodes: DataFrame) -> DataFrame:
    return writers.clines(nodes).select("doc_id", "pre", "line")


_NAMES = {"n_nationkey": "CAST(n_nationkey AS VARCHAR)", "n_name": "n_name", "n_regionkey": "CAST(n_regionkey AS VARCHAR)"}


def _shown(*lines: tuple[int, str, str]) -> str:
    """SQL of path lines, as (pre, path, value)."""
    pres, texts = ", ".join(str(p) for p, _, _ in lines), ", ".join(f"""'{path}="' || {value} || '"'""" for _, path, value in lines)
    return f"SELECT CAST(n_nationkey AS BIGINT) AS doc_id, unnest([{pres}]) AS pre, unnest([{texts}]) AS line FROM nation"


_KEY, _NAME, _REGION = _NAMES.values()
for _name, _change, _sql in (
    ("table_delete", lambda n: mutate.delete(n, "//n_name"), _shown((2, "/_/n_nationkey", _KEY), (4, "/_/n_regionkey", _REGION))),
    ("table_replace", lambda n: mutate.replace(n, "/_/n_name", "gone"), _shown((2, "/_/n_nationkey", _KEY), (4, "/_/n_name", "'gone'"), (6, "/_/n_regionkey", _REGION))),
    ("table_add_root", lambda n: mutate.add_root(n, "top"), _shown((3, "/top/_/n_nationkey", _KEY), (5, "/top/_/n_name", _NAME), (7, "/top/_/n_regionkey", _REGION))),
    ("table_add", lambda n: mutate.add(n, "extra{k=1}"), _shown((2, "/_/n_nationkey", _KEY), (4, "/_/n_name", _NAME), (6, "/_/n_regionkey", _REGION), (9, "/extra/k", "'1'"))),
    ("table_set_attribute", lambda n: mutate.set_attribute(n, "/_/n_name", "v", "1"), _shown((2, "/_/n_nationkey", _KEY), (4, "/_/n_name/@v", "'1'"), (5, "/_/n_name", _NAME), (7, "/_/n_regionkey", _REGION))),
    ("table_select_reverse", lambda n: mutate.select(n, "/_/n_nationkey | /_/n_regionkey"), _shown((1, "/n_regionkey", _REGION), (3, "/n_nationkey", _KEY))),
):
    QUERIES[_name] = lambda spark, sf_dir, change=_change: _lines(change(_nations(spark, sf_dir)))
    SQL[_name] = _sql


def _letters(spark, sf_dir) -> DataFrame:
    """A letter to each customer with references to an entity of a name and to a character."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("p{'Dear '&name;', '&#65;'"), F.col("c_custkey"), F.lit("'}")).alias("t"))
    return readers.stored(readers.nodes(readers.dealt(c, "doc_id"), "t", kind="brace", merge=False), _scratch(spark))


for _name, _change, _sql in (
    ("table_entity_replace", lambda n: mutate.replace_entity(n, "name", "you"), "'Dear you, <ENTITY>#65' || c_custkey"),
    ("table_entity_delete", lambda n: mutate.delete_entity(n, "name"), "'Dear , <ENTITY>#65' || c_custkey"),
    ("table_char_entity", mutate.substitute_entity, "'Dear <ENTITY>name, A' || c_custkey"),
    ("table_entity_tree", lambda n: mutate.replace_entity_with_tree(n, "name", "q{x=a y=b}"), "'Dear ab, <ENTITY>#65' || c_custkey"),
):
    QUERIES[_name] = lambda spark, sf_dir, change=_change: writers.to_text(change(_letters(spark, sf_dir)))
    SQL[_name] = f"SELECT c_custkey AS doc_id, {_sql} AS text FROM customer"


@query("SELECT s_suppkey AS doc_id, 'NAME=' || s_name || ' NATION=' || s_nationkey AS line FROM supplier")
def table_foreach(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct("s_name", "s_nationkey")).alias("t"))
    nodes = readers.stored(readers.nodes(s, "t", "s_suppkey", kind="json"), _scratch(spark))
    return measure.foreach(nodes, "/_", "NAME=${s_name} NATION=${s_nationkey}").select("doc_id", "line")


# -- one document in the files of a folder, parsed by many tasks


def _one_document(spark, rows: DataFrame, before: str, after: str) -> str:
    """The path of a folder of text files, in the order of their names a line before, a line a row and a line after. Tasks write their rows by themselves."""
    where = _scratch(spark)
    line = lambda x: spark.range(0, 1, 1, 1).select(F.lit(x).alias("value"))
    line(before).unionByName(rows).unionByName(line(after)).write.text(where)
    return where


@query("SELECT path, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS places FROM (SELECT '/_/_' AS path, 1 + count(*) AS n FROM orders UNION ALL SELECT unnest(['/_/_/k', '/_/_/c']), count(*) FROM orders)")
def huge_json(spark, sf_dir):
    """All orders as one JSON array over many files."""
    o = _t(spark, sf_dir, "orders").select(F.concat(F.lit(","), F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.concat(F.lit("a, b: "), "o_custkey").alias("c")))).alias("value"))
    nodes = chunked.read(spark, _one_document(spark, o, "[{}", "]"), "json", _scratch(spark), size=1 << 16, parts=True)
    return nodes.filter("kind = 'element' and level > 0").groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("pre").alias("places"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus || ' of ' || o_custkey AS note FROM orders")
def huge_xml(spark, sf_dir):
    """All orders as one XML document over many files: an attribute and a text of each, put together by their parent."""
    o = _t(spark, sf_dir, "orders").select(F.concat(F.lit('<order id="'), "o_orderkey", F.lit('"><!-- <x> --><note>'), "o_orderstatus", F.lit("<![CDATA[ of ]]>"), "o_custkey", F.lit("</note></order>")).alias("value"))
    nodes = chunked.read(spark, _one_document(spark, o, "<orders>", "</orders>"), "xml", _scratch(spark), size=1 << 16, parts=True)
    kept = readers.stored(nodes, _scratch(spark))
    ids = kept.filter("path = '/orders/order/@id'").select("parent", F.col("value").alias("id"))
    notes = kept.filter("path = '/orders/order/note' and kind = 'element'").select("parent", "pre")
    texts = kept.filter("path = '/orders/order/note' and kind = 'text'").select(F.col("parent").alias("pre"), F.col("value").alias("note"))
    return ids.join(notes, "parent").join(texts, "pre").select("id", "note")


@query("""WITH l AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS line_no, strlen(props) + 1 AS size, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT line_no, CAST(coalesce(sum(size) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", k FROM l""")
def line_numbers(spark, sf_dir):
    """Lines of one text file with their numbers and places."""
    where = _scratch(spark)
    _t(spark, sf_dir, "events").orderBy("event_id").coalesce(1).select("props").write.text(where)
    lines = readers.lines(spark, where, offsets=True)
    return lines.select("line_no", "offset", F.get_json_object("raw", "$.k").cast("long").alias("k"))


@query("""SELECT d.doc_id, CAST(d.doc_id % 300 AS VARCHAR) AS key, (SELECT min_by(p.url, p.page_id) FROM pages p WHERE p.page_id % 200 = d.doc_id % 300) AS value FROM documents d""")
def document_lookup(spark, sf_dir):
    """Documents that refer to pages by a number, and the address of the first page that has it."""
    texts = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<d lang='"), "lang", F.lit("'><ref>"), F.col("doc_id") % 300, F.lit("</ref></d>")).alias("t"))
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("<page no='"), F.col("page_id") % 200, F.lit("'><url>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</url></page>")).alias("t"))
    left, right = (readers.stored(readers.nodes(x, "t", kind="xml"), _scratch(spark)) for x in (texts, pages))
    return lookup.lookup(left, "/d/ref", right, "/page", "@no", "url").select("doc_id", "key", "value")


# -- regular grammars, as expressions

_LOG = "line = level, -' ', message. level = ['A'-'Z']+. message = ~[#a]+."
_RECORD = "row = key, -',', name, -',', region. key = ['0'-'9']+. name = ~[',']*. region = ['0'-'9']+."


@query(SQL["ixml_url"])
def regular_url(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return regular.fields(pages, "url", "ixml:data/url", ("scheme", "host", "path"))


@query("SELECT level, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM (SELECT upper(event_type) AS level, props FROM events) WHERE regexp_matches(level, '^[A-Z]+$') GROUP BY 1")
def regular_log(spark, sf_dir):
    """Log lines, counted by their levels."""
    lines = _t(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.upper("event_type"), F.lit(" "), "props").alias("line"))
    found = regular.fields(lines, "line", _LOG, ("level", "message")).filter("level is not null")
    return found.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.get_json_object("message", "$.k").cast("long")).alias("total"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, CAST(c_nationkey AS VARCHAR) AS region FROM customer")
def regular_records(spark, sf_dir):
    lines = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat_ws(",", "c_custkey", "c_name", "c_nationkey").alias("line"))
    return regular.fields(lines, "line", _RECORD, ("key", "name", "region")).drop("doc_id")


# -- schemas as columns


@query(SQL["validate_int"])
def relational_validate(spark, sf_dir):
    """Integers between bounds, by expressions on a stored table of nodes."""
    schema = "xs:schema(xmlns:xs = http://www.w3.org/2001/XMLSchema) { xs:element(name = _) { xs:complexType { xs:sequence { xs:element(name = k type = K) } } } xs:simpleType(name = K) { xs:restriction(base = xs:int) { xs:minInclusive(value = 10) xs:maxInclusive(value = 50) } } }"
    nodes = readers.stored(readers.nodes(_t(spark, sf_dir, "events"), "props", "event_id", kind="json"), _scratch(spark))
    wrong = schema_frames.violations(nodes, xsd.compile(brace.parse(schema)), "_").select("doc_id").distinct().withColumn("wrong", F.lit(True))
    return nodes.filter("pre = 0").join(wrong, "doc_id", "left").select("doc_id", F.col("wrong").isNull().alias("valid"))


@query("SELECT c_custkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS k FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def relational_keyref(spark, sf_dir):
    """Ids of orders in the documents of customers that no document of a line with the flag R has, as keys of two tables."""
    lines = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("<line of='"), "l_orderkey", F.lit("'/>")).alias("t"))
    keys = schema_frames.keys(readers.stored(readers.nodes(lines, "t", kind="xml"), _scratch(spark)), "/line", ["@of"])
    refs = schema_frames.keys(_accounts(spark, sf_dir), "/customer/order", ["@id"])
    return schema_frames.broken(refs, keys, across=True).select("doc_id", F.col("k0").alias("k"))


# -- table functions


def _sql(text: str):
    def run(spark, sf_dir):
        tables.register(spark)
        for t in ("pages", "nation"):
            if t in text:
                _t(spark, sf_dir, t).createOrReplaceTempView(f"arbolith_{t}")
        return spark.sql(text)

    return run


for _name, _spark, _sql_text in (
    ("udtf_nodes", "SELECT page_id AS doc_id, count_if(n.name = 'a' AND n.kind = 'element') AS links, count_if(n.kind = 'comment') AS comments FROM arbolith_pages, LATERAL tree_nodes(html, 'html') n GROUP BY page_id",
     "SELECT page_id AS doc_id, CAST(len(regexp_extract_all(html, '<a[ >]')) AS BIGINT) AS links, CAST(1 AS BIGINT) AS comments FROM pages"),
    ("udtf_tokens", "SELECT n_nationkey AS doc_id, t.i, t.text FROM arbolith_nation, LATERAL brace_tokens(concat('n{k=', n_nationkey, '}')) t WHERE t.kind NOT LIKE '%space%'",
     "SELECT n_nationkey AS doc_id, unnest([0, 1, 2, 3, 4, 5]) AS i, unnest(['n', '{', 'k', '=', CAST(n_nationkey AS VARCHAR), '}']) AS text FROM nation"),
    ("udtf_grammar", "SELECT page_id AS doc_id, u.scheme, u.host FROM arbolith_pages, LATERAL grammar_rows(url, 'ixml:data/url', '/url', scheme => 'scheme', host => 'host') u",
     "SELECT page_id AS doc_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages"),
):
    QUERIES[_name] = _sql(_spark)
    SQL[_name] = _sql_text


@query("""WITH l AS (SELECT o_orderkey, o_orderstatus, l_returnflag, l_orderkey || ':' || l_linenumber AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
e AS (SELECT l_returnflag AS tag, count(*) AS n, sum(strlen(t) + 7) AS size FROM l GROUP BY 1
  UNION ALL SELECT o_orderstatus, count(*), sum(strlen(CAST(o_orderkey AS VARCHAR)) + 13) FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM l) GROUP BY 1
  UNION ALL SELECT '', count(*), sum(strlen(CAST(o_orderkey AS VARCHAR)) + 10) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l))
SELECT tag, CAST(n AS BIGINT) AS n, (SELECT CAST(17 + sum(size) AS BIGINT) FROM e) AS total FROM e WHERE n > 0""")
def huge_written(spark, sf_dir):
    """The document of all orders as XML, in parts that many tasks write: how many elements of each name end in it, by tag, or with no content, and its length."""
    where = _scratch(spark)
    streamed.xml(_ledger(spark, sf_dir), declaration=False, size=1 << 14).write.parquet(where)
    parts = spark.read.parquet(where)
    tags = parts.select(F.explode(F.expr("regexp_extract_all(text, '</([A-Z])>|/>', 1)")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return tags.crossJoin(F.broadcast(parts.agg(F.sum(F.length("text")).alias("total")))).select("tag", "n", "total")


@query(SQL["json_roundtrip"])
def written_json(spark, sf_dir):
    """Documents as JSON in parts, put together again."""
    nodes = readers.stored(readers.nodes(_t(spark, sf_dir, "events"), "props", "event_id", kind="json"), _scratch(spark))
    parts = streamed.json(nodes, size=4).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("p"))
    return parts.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
