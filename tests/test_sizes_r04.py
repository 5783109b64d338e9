"""What the findings of round 4 on growth were about: plans that do a step once, and the same rows as before."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbolith import node_queries
from arbolith.plans import containment, twig
from arbolith.sinks import streamed, writers
from arbolith.sources import readers


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _ledger_tables(spark, where: str) -> dict[int, list]:
    orders = {k: "FOP"[k % 3] for k in range(1, 60)}
    lines = {k: [(n // 2, "ARN"[(k + n) % 3]) for n in range(k % 5)] for k in [*orders, 99]}  # numbers repeat; 99 has no order
    spark.createDataFrame(list(orders.items()), "o_orderkey long, o_orderstatus string").write.parquet(f"{where}/orders.parquet")
    rows = [(k, n, i, 0, flag) for k, x in lines.items() for i, (n, flag) in enumerate(x)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{where}/lineitem.parquet")
    inner = "".join(f'<{s} id="{k}">' + "".join(f"<{flag}>{k}:{n}</{flag}>" for n, flag in lines[k]) + f"</{s}>" for k, s in orders.items())
    return f"<orders>{inner}</orders>"


def test_the_ledger_is_numbered_without_sorting_its_nodes(spark, tmp_path, monkeypatch):
    text = _ledger_tables(spark, f"file://{tmp_path}/t")
    plans, stored = [], readers.stored
    monkeypatch.setattr(readers, "stored", lambda nodes, path: plans.append(_plan(nodes)) or stored(nodes, path))
    nodes = node_queries._ledger(spark, f"file://{tmp_path}/t")
    want = readers.nodes(spark.createDataFrame([(0, text)], "doc_id long, t string"), "t", kind="xml")
    assert sorted(nodes.collect(), key=lambda r: r.pre) == sorted(want.collect(), key=lambda r: r.pre)
    assert plans[0].splitlines()[1].startswith("+- Union") and "rangepartitioning" not in plans[0]


def test_parts_of_xml_need_no_sample_and_no_join(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "<a k='1' l='&nbsp;x'>" + f"<b n='{i}'/>t" * 20 + "</a>") for i in range(5)], "doc_id long, t string")
    nodes = readers.stored(readers.nodes(df, "t", merge=False), f"file://{tmp_path}/nodes")
    want = {r.doc_id: r.text for r in writers.render(nodes, "xml").collect()}
    monkeypatch.setattr(streamed, "PLACES", 8)
    parts = streamed.xml(nodes)
    assert "Join" not in _plan(parts) and "rangepartitioning" not in _plan(parts)
    found: dict[int, list] = {}
    for r in parts.collect():
        found.setdefault(r.doc_id, []).append((r.place, r.text))
    assert {i: "".join(t for _, t in sorted(x)) for i, x in found.items()} == want
    assert all(len({max(p, 0) // 8 for p, _ in x}) == len(x) > 10 for x in found.values())


def test_joins_by_ranges_shuffle_a_number_twice_at_most(spark):
    assert containment.numbers(spark.range(100), F.col("id")).count() <= 200
    # ranges on either side of where the scales part, and leaves: all pairs, once
    spans = spark.createDataFrame([(a, a + n - 1) for a in (0, 15, 16, 2040) for n in (1, 127, 128, 129, 130, 2048, 5000)], "a long, b long")
    found = containment.pairs(spark.range(8000).selectExpr("1L doc", "id"), F.col("id"), spans.withColumn("doc", F.lit(1).cast("long")), F.col("a"), F.col("b"), ["doc"])
    assert found.count() == found.distinct().count() == 4 * (1 + 127 + 128 + 129 + 130 + 2048 + 5000)


def test_patterns_test_a_name_once_and_hold_sets_only_for_results():
    machine = twig.Machine(twig.compiled("/r[b]/a/@id"))
    looked, tests = [], machine.tests
    machine.tests = [lambda n, t=t: looked.append(1) or t(n) for t in tests]
    held = []
    for i in range(100):
        node = {"doc_id": 0, "pre": i + 1, "post": i, "parent": 0, "level": 1, "kind": "element", "prefix": None, "name": "ab"[i % 2], "value": None, "path": "/r/x"}
        machine.see(node, i + 1)
        held += [*machine.stack[-1].hangs, *machine.stack[-1].far]
    assert len(looked) == 2 * len(tests) and not held
