"""Findings of round 4 on stores of documents made from tables: plain XML without a tree, texts that many tasks parse, values without joins."""

from __future__ import annotations

import random

from arbolith import node_queries
from arbolith.model import shred
from arbolith.plans import xpath_frames
from arbolith.sources import markup, readers


def _random(r: random.Random, depth: int) -> str:
    name = r.choice(["a", "b", "x:c"] if r.random() < 0.1 else ["a", "b"])
    head = "".join(f' {k}="{r.choice(["1", "", " z "])}"' for k in r.sample(["k", "l"], r.randrange(3)))
    parts = ["", "text", " ", " t ", "é "] + (["<!-- c -->", "&lt;", "\n x"] if r.random() < 0.05 else [])
    return f"<{name}{head}>{''.join(_random(r, depth - 1) if depth and r.random() < 0.5 else r.choice(parts) for _ in range(r.randrange(6)))}</{name}>"


def test_rows_of_plain_xml_are_those_of_its_tree():
    plain = 0
    for seed in range(2000):
        text = _random(random.Random(seed), 3)
        for trimmed in (True, False):
            if (got := markup.plain_rows(text, 7, trimmed)) is not None:
                plain += 1
                assert got == shred(markup.parse_xml(text, trimmed), 7)
    assert plain > 1000
    assert all(markup.plain_rows(t, 7) is None for t in ("<a>", "<a/>x", "", "x", '<a xmlns="u"/>', "<a><![CDATA[x]]></a>", "﻿<a/>"))


def test_plain_xml_is_read_without_a_tree(spark, monkeypatch):
    tops = [r for r in readers.nodes(spark.createDataFrame([(1, "<a k='1'>x</a>")], "doc_id long, t string"), "t", kind="xml").collect()]
    monkeypatch.setattr(markup, "parse_xml", None)
    assert [tuple(r) for r in tops] == markup.plain_rows("<a k='1'>x</a>", 1)


def test_orders_of_customers_reach_many_tasks_without_a_broadcast(spark, tmp_path):
    spark.range(300).selectExpr("id c_custkey", "'BUILDING' c_mktsegment", "1.5D c_acctbal").coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    spark.range(300).selectExpr("id o_orderkey", "id % 299 o_custkey", "'F' o_orderstatus", "'1-URGENT' o_orderpriority").coalesce(1).write.parquet(f"file://{tmp_path}/orders.parquet")
    texts = node_queries._account_xml(spark, f"file://{tmp_path}")
    parts = texts.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(parts) == 300 and max(parts) < 150
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_values_of_attributes_and_texts_need_no_join_with_texts(spark, monkeypatch):
    nodes = readers.nodes(spark.createDataFrame([(1, "<r><o st='P' id='1'/><o st='F' id='2'>t</o></r>")], "doc_id long, t string"), "t", kind="xml").cache()
    select = lambda p: sorted(r.value for r in xpath_frames.select(nodes, p).collect())
    want = select("//o[. = 't']/@id")
    monkeypatch.setattr(xpath_frames, "string_values", None)
    assert select("//o[@st='P']/following-sibling::o[@st='F']/@id") == select("//o[text() = 't']/@id") == want == ["2"]


def test_comparing_with_a_constant_needs_no_join_for_it(spark):
    nodes = readers.nodes(spark.createDataFrame([(1, "<r><o st='P'>5</o><o st='F'>6</o></r>")], "doc_id long, t string"), "t", kind="xml").cache()
    found = xpath_frames.select(nodes, "//o[@st='P']")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.pre for r in found.collect()] == [1]
    assert sum("Join " in line for line in plan.splitlines()) == 4  # from documents, to attributes and back
    assert [r.pre for r in xpath_frames.select(nodes, "//o[. > -5 and . < 6]").collect()] == [1]
