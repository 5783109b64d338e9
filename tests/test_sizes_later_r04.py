"""Findings of round 4 on growth: a document over many files, joins of its nodes, large documents, texts of small files."""

from __future__ import annotations

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from arbolith import node_queries
from arbolith.model import shred
from arbolith.session import ship
from arbolith.sources import chunked, markup, readers
from arbolith.sources.brace import ParseError


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def _parts(folder, kind: str) -> str:
    """A document over three files; its text."""
    rows = [f'<o id="{i}"><!-- <x> -->t<![CDATA[ of ]]>{i}</o>' if kind == "xml" else f',{{"k":{i},"c":"a, b"}}' for i in range(90)]
    lines = ["<r>" if kind == "xml" else "[{}", *rows, "</r>" if kind == "xml" else "]"]
    folder.mkdir()
    for i in range(3):
        (folder / f"part-0000{i}.txt").write_text("\n".join(lines[i * 31 : i * 31 + 31]) + "\n")
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("kind", ["xml", "json"])
def test_a_document_over_many_files_gives_what_the_whole_gives(spark, tmp_path, kind):
    text = _parts(tmp_path / "in", kind)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = chunked.read(spark, f"file://{tmp_path}/in", kind, f"file://{tmp_path}/work", size=100, parts=True).drop("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = readers.nodes(spark.createDataFrame([(0, text)], "doc_id long, t string"), "t", kind=kind).drop("doc_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("kind", ["xml", "json"])
def test_nodes_of_a_document_of_many_chunks_do_not_meet_in_one_task(spark, tmp_path, kind):
    (tmp_path / "one.txt").write_text(_parts(tmp_path / "in", kind))
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        nodes = chunked.read(spark, f"file://{tmp_path}/one.txt", kind, f"file://{tmp_path}/work", size=300)
        sizes = [r["count"] for r in nodes.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k in held:
            spark.conf.unset(k)
    assert max(sizes) < sum(sizes) * 0.6


def _random_xml(r: random.Random, depth: int) -> str:
    name = r.choice(["a", "b", "x:c"])
    head = "".join(f' {k}="{r.choice(["1", "&amp;", "x"])}"' for k in r.sample(["k", "x:l", "xmlns:x", "xmlns"], r.randrange(3)))
    parts = ["", "text", " ", "\n  t\n  u\n", "&lt;", "&nbsp;", "<!-- c\n -->", "<![CDATA[<b>]]>", "<?p v?>"]
    return f"<{name}{head}>{''.join(_random_xml(r, depth - 1) if depth and r.random() < 0.5 else r.choice(parts) for _ in range(r.randrange(6)))}</{name}>"


@pytest.mark.parametrize("trimmed", [True, False])
def test_rows_of_large_xml_without_its_tree_are_those_of_the_tree(trimmed):
    for seed in range(400):
        r = random.Random(seed)
        text = f'\ufeff<!DOCTYPE r [<!ENTITY e "v">]><!-- x --><r xmlns:x="u">{"".join(_random_xml(r, 4) for _ in range(r.randrange(5)))}&e;</r>\n<!-- y -->'
        want = shred(markup.parse_xml(text, trimmed), 7)
        for ends in (1, 2, 5):
            assert sorted(x for rows in markup.xml_rows(text, 7, trimmed, ends) for x in rows) == want


def test_large_xml_takes_no_more_memory_than_its_text_and_errs_first(spark, monkeypatch):
    rows = [f'<c id="{i}"><b>{i}</b></c>' for i in range(60_000)]
    text = f"<n>{''.join(rows)}</n>"
    tracemalloc.start()
    n = sum(len(x) for x in markup.xml_rows(text, 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1 + 4 * 60_000 and peak < 12 * len(text)
    with pytest.raises(ParseError) as a:
        next(markup.xml_rows(text + "<", 1))
    with pytest.raises(ParseError) as b:
        markup.parse_xml(text + "<")
    assert str(a.value) == str(b.value)
    monkeypatch.setattr(readers, "_LARGE", 10)
    df = spark.createDataFrame([(1, "<n><c>x</c><c/></n>"), (2, "<n><c>y</c><c></n>"), (3, None)], "doc_id long, t string")
    assert sorted((r.doc_id, r.pre, r.kind) for r in readers.nodes(df, "t", kind="xml").collect()) == [(1, 0, "element"), (1, 1, "element"), (1, 2, "text"), (1, 3, "element"), (2, 0, "error")]


def test_letters_of_one_small_file_are_parsed_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.range(200).selectExpr("id c_custkey").coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    parsed, stored = [], readers.stored
    monkeypatch.setattr(readers, "stored", lambda nodes, path: parsed.append(nodes.groupBy(F.spark_partition_id()).count().count()) or stored(nodes, path))
    assert node_queries._letters(spark, f"file://{tmp_path}").select("doc_id").distinct().count() == 200 and parsed[0] > 1
