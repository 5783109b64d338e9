"""What the findings of round 4 were about."""

from __future__ import annotations

import pyarrow as pa

from arbolith.grammar import earley, registry
from arbolith.operators import mutate
from arbolith.plans import trees, xpath, xpath_tree, xslt
from arbolith.sinks import markup, streamed, writers
from arbolith.sources import brace, readers
from arbolith.sources.markup import parse_html, parse_xml


def test_references_by_name_need_their_semicolon_in_html():
    title = xpath_tree.evaluate(xpath.parse("/html/head/title"), xpath_tree.Context(parse_html("<title>a&amp;b &amp&amp;&lt c &nix; &#65;&amp</title>")))
    assert title[0].text() == "a&b &amp&&lt c &nix; A&amp"


def test_keys_of_stylesheets_are_looked_up_without_sorting(monkeypatch):
    sheet = xslt.compile(brace.parse("xsl:stylesheet(version = 1.0 xmlns:xsl = http://www.w3.org/1999/XSL/Transform) { xsl:key(name = s match = c use = @seg) xsl:template(match = /n) { out { xsl:for-each(select = \"c[generate-id() = generate-id(key('s', @seg)[1])]\") { xsl:value-of(select = @seg) '=' xsl:value-of(select = \"count(key('s', @seg))\") ';' } } } }"))
    seen, looked = [], []
    ordered, at = xpath_tree.ordered, xpath_tree.Context.at
    monkeypatch.setattr(xpath_tree, "ordered", lambda nodes: seen.append(len(nodes)) or ordered(nodes))
    monkeypatch.setattr(xpath_tree.Context, "at", lambda c, *a: looked.append(1) or at(c, *a))
    doc = parse_xml("<n>" + "".join(f"<c seg='{'xyz'[i % 3]}'/>" for i in range(600)) + "</n>")
    assert markup.text(xslt.transform(sheet, doc)) == "x=200;y=200;z=200;"
    assert sum(seen) + len(looked) < 600 * 5  # 600 keys of 200 nodes each, looked through one by one, are 120,000


def test_results_of_repeated_short_texts_are_remembered():
    memory = trees._Memory.of("a query")
    memory.keep(("x",), [("1", None)])
    assert trees._Memory.of("a query").get(("x",)) == [("1", None)]
    memory.keep(("y",), [("z" * 10_000,)])
    assert ("y",) not in memory
    for i in range(trees._REMEMBERED + 10):
        memory.keep((str(i),), [])
    assert len(memory) == trees._REMEMBERED
    for i in range(trees._QUERIES):
        trees._Memory.of(f"other {i}")
    assert "a query" not in trees._memory


def test_grammar_results_of_repeated_texts_keep_their_rows(spark):
    df = spark.range(3000).selectExpr("id doc_id", "case when id % 7 = 0 then null when id % 5 = 0 then '?' else repeat('a', int(id % 3) + 1) end t").coalesce(1)
    made = trees.parsed(df, "t", "n = 'a'+.").each(lambda doc: [(doc.children[0].name, len(doc.children[0].text()))], "name string, n int")
    assert made.rdd.getNumPartitions() > 1
    got = {r.doc_id: (r.name, r.n) for r in made.collect()}
    assert len(got) == made.count() == sum(i % 7 > 0 for i in range(3000))
    assert all(got[i][0] == "ixml" if i % 5 == 0 else got[i] == ("n", i % 3 + 1) for i in got)


def test_characters_that_no_terminal_reads_are_skipped_without_a_search(monkeypatch):
    grammar = "n = ['0'-'9']+, (-',', n)?."
    texts = ["!1?O2!", "1,,2", "a,1,b2,", "x", "7", "1;,2"]
    kept = {t: earley.kept_characters(registry.machine(grammar), t) for t in texts}
    shown = {t: registry.parse_text(grammar, t, recover=True) for t in texts}
    assert {t: len(k) for t, k in kept.items() if k is not None} == {t: len(t) - int(d.children[0].attr("skipped").text() if d.children[0].attr("skipped") else 0) for t, d in shown.items() if d.children[0].name == "n"}
    monkeypatch.setattr(registry, "kept_characters", None)
    doc = registry.parse_text(grammar, "!1?O2!", recover=True)
    assert (doc.text(), doc.children[0].attr("skipped").text()) == ("12", "4")


def test_changes_of_tables_of_nodes_send_nothing_of_their_size_through_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "BROADCAST_ROWS", 10)
    df = spark.range(50).selectExpr("id doc_id", "concat('p{\\'Dear \\'&name;\\', \\'', id, '}') t")
    nodes = readers.stored(readers.nodes(df, "t", kind="brace", merge=False), f"file://{tmp_path}/nodes")
    for changed in (mutate.delete_entity(nodes, "name"), mutate.replace_entity_with_tree(nodes, "name", "q{x=a}"), mutate.substitute_entity(nodes)):
        plan = writers.to_text(changed)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_written_json_sends_no_nodes_through_the_driver_and_comes_in_large_batches(spark, tmp_path):
    nodes = readers.stored(readers.nodes(spark.range(40).selectExpr("id doc_id", "concat('{\"k\":', id, '}') t"), "t", kind="json"), f"file://{tmp_path}/nodes")
    plan = streamed.json_pieces(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    pieces = pa.RecordBatch.from_pydict({"doc_id": [1, 1, 2, 3], "place": [0, 1, 0, 0], "piece": ["ab", "cd", "e", "f"]})
    batches = list(streamed._parts(iter([pieces]), 2))
    assert len(batches) == 1 and batches[0].to_pydict() == {"doc_id": [1, 1, 2, 3], "place": [0, 1, 0, 0], "text": ["ab", "cd", "e", "f"]}
