"""Documents cut into chunks give the rows that whole ones give."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from arbolith.functions import tables
from arbolith.session import ship
from arbolith.sinks import streamed, writers
from arbolith.sources import chunked, readers


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def xml(r: random.Random, depth: int) -> str:
    n = r.choice(["a", "b", "x:c"])
    att = "".join(f' {k}="{r.choice(["1", "x > y", "", "&amp;"])}"' for k in r.sample(["k", "l", "xmlns:x"], r.randrange(3)))
    parts = [r.choice([xml(r, depth - 1) if depth else "", r.choice(["text", " ", "\n  ", "a > b", "&lt;", "&nbsp;"]), r.choice(["<!-- c <a> - -->", "<![CDATA[ <b> ]] > ]]>", "<?p v <x> ?>"])]) for _ in range(r.randrange(6))]
    return f"<{n}{att}>{''.join(parts)}</{n}>" if parts else f"<{n}{att}/>"


def value(r: random.Random, depth: int) -> object:
    k = r.randrange(6) if depth else 5
    if k < 3:
        return {r.choice(["a", "b c", 'd,e"f\\', "x:y", "9"]): value(r, depth - 1) for _ in range(r.randrange(5))}
    return [value(r, depth - 1) for _ in range(r.randrange(5))] if k < 5 else r.choice(["x,y", 'a"b,c{', 1, -2.5, True, None, "", "5"])


def files(seed: int) -> dict[str, list[str]]:
    r = random.Random(seed)
    markup = [f'<?xml version="1.0"?><!DOCTYPE r><!-- x --><root xmlns:x="u">{"".join(xml(r, 4) for _ in range(12))}</root>\n<!-- end -->\n' for _ in range(4)]
    data = [json.dumps([value(r, 5) for _ in range(12)], ensure_ascii=False) for _ in range(4)] + ['{"_":"named","a":[1,2,{"b":"c"}]}', "[]", " { } "]
    return {"xml": markup, "json": data}


@pytest.mark.parametrize("kind", ["xml", "json"])
@pytest.mark.parametrize("size", [1, 60])
def test_chunks_give_what_whole_documents_give(spark, tmp_path, kind, size):
    """Files that Spark splits every few hundred bytes, cut again where it splits and within."""
    for i, text in enumerate(files(size)[kind]):
        (tmp_path / f"{i}.txt").write_text(text)
    folder = f"file://{tmp_path}"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = chunked.read(spark, f"{folder}/*.txt", kind, f"{folder}/work", size=size).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.xxhash64("_metadata.file_path").alias("doc_id"), "value")
    want = readers.nodes(whole, "value", kind=kind).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    parts = spark.read.parquet(f"{folder}/work/chunks")
    assert parts.select("file", "block").distinct().count() > len(files(size)[kind]) and parts.count() > 40


@pytest.mark.parametrize(("kind", "text", "message"), [("xml", "<a><b></b>", "no end"), ("xml", "<a></a></b>", "isn't open"), ("json", "[1,2", "no end"), ("json", "[1,2]]", "isn't open"), ("json", '{"a":{"b":1},"_c":2}', "too late"), ("json", '"a"', "container")])
def test_what_is_wrong_is_said(spark, tmp_path, kind, text, message):
    (tmp_path / "0.txt").write_text(text)
    rows = chunked.read(spark, f"file://{tmp_path}/0.txt", kind, f"file://{tmp_path}/work", size=1).filter("kind = 'error'").collect()
    assert rows and message in rows[0].value


def test_documents_are_written_in_parts(spark, tmp_path):
    """Parts of a few characters, put together, are the whole text, with all that XML has."""
    texts = [(i, t) for i, t in enumerate([*files(3)["xml"], "<a k='1' l='&nbsp;x&lt;\"'><b/>&copy;<!-- a - - b---><c><![CDATA[]]></c></a>", "<r/>", "<r>&amp;&#13;</r>"])]
    df = spark.createDataFrame([*texts, (9, "p{'Dear '&name;', '&#65;}"), (10, "a(k=('x'&y;'<'))"), (11, "x y z=1 //c--d-\n !DOCTYPE=q")], "doc_id long, t string")
    nodes = readers.stored(readers.nodes(df, "t", merge=False), f"file://{tmp_path}/nodes")
    want = {r.doc_id: r.text for r in writers.render(nodes, "xml").collect()}
    found: dict[int, list] = {}
    for r in streamed.xml(nodes, size=7).collect():
        found.setdefault(r.doc_id, []).append((r.place, r.text))
    assert {i: "".join(t for _, t in sorted(x)) for i, x in found.items()} == want
    assert max(len(x) for x in found.values()) > 50


def test_documents_are_written_as_json_in_parts(spark, tmp_path):
    r = random.Random(5)
    data = [json.dumps(value(r, 5), ensure_ascii=False) for _ in range(25)]
    data += ['{"_":"named","_id":"1","a":[1,2,{"b":"c"}],"":3}', "[]", "{}", '"5"', "5", '{"a":"1","a":2,"b":null,"c":"","d":"\\u0001\\n\\"\\\\"}', '[{"_":"x","y":1},[[]],{"_z":null}]']
    markup = ["<a><!--x--><b/>t<!--y--><c/>u</a>", "<a k='1' xmlns='u' xmlns:p='v'><p:b>1</p:b><b S=''>1</b>&nbsp;tail&copy;</a>", "<_ A=''><x/>text<y>1</y></_>", "<a><![CDATA[1]]></a>", "<a>x&nbsp;</a>", "<a><b>1<!--c--></b><b>2</b></a>", "<a _='q'><_ _='1 2'>z</_><_ _='1 2'/></a>"]
    tables = [readers.nodes(spark.createDataFrame(list(enumerate(x, start)), "doc_id long, t string"), "t", kind=k) for k, x, start in (("json", data, 0), ("xml", markup, 100))]
    nodes = readers.stored(tables[0].unionByName(tables[1]), f"file://{tmp_path}/nodes")
    found: dict[int, list] = {}
    for x in streamed.json(nodes, size=9).collect():
        found.setdefault(x.doc_id, []).append((x.place, x.text))
    assert {i: "".join(t for _, t in sorted(x)) for i, x in found.items()} == {x.doc_id: x.text for x in writers.render(nodes, "json").collect()}


@pytest.mark.parametrize("size", ["20b", "77b", "1g"])
def test_line_numbers_do_not_depend_on_splits(spark, tmp_path, size):
    text = "".join(f"line {i} é\n" for i in range(60)) + "\r\n\nlast"
    for n in ("a", "b"):
        (tmp_path / f"{n}.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        rows = readers.lines(spark, f"file://{tmp_path}/*.txt", offsets=True).collect()
        plain = readers.lines(spark, f"file://{tmp_path}/*.txt").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want, at = [], 0
    for i, line in enumerate(text.split("\n")):
        want.append((i, at, line.rstrip("\r")))
        at += len(line.encode()) + 1
    for n in ("a", "b"):
        assert sorted((r.line_no, r.offset, r.raw) for r in rows if r.source.endswith(f"{n}.txt")) == want
    assert len({r.doc_id for r in rows}) == len(rows) == 2 * len(want) and {(r.doc_id, r.line_no) for r in plain} == {(r.doc_id, r.line_no) for r in rows}


def test_table_functions_of_sql(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "a{b=1}"), (2, "{"), (3, None)], "k long, t string").createOrReplaceTempView("some_texts")
    rows = spark.sql("SELECT k, n.path, n.kind FROM some_texts, LATERAL tree_nodes(t, 'brace') n").collect()
    assert sorted(map(tuple, rows)) == [(1, "/a", "element"), (1, "/a/b", "element"), (1, "/a/b", "text"), (2, "", "error")]
    assert [r.text for r in spark.sql("SELECT n.text FROM some_texts, LATERAL brace_tokens(t) n WHERE k = 1 ORDER BY n.i").collect()] == ["a", "{", "b", "=", "1", "}"]
    found = spark.sql("SELECT * FROM grammar_rows('a,1\nb,2', 'ixml:data/csv', '/table/tr', name => 'td[1]', n => 'td[2]')")
    assert found.columns == ["name", "n"] and [tuple(r) for r in found.collect()] == [("a", "1"), ("b", "2")]
    for bad in ("tree_nodes('a', 'pdf')", "grammar_rows('a', 'ixml:data/csv', '/table[')", "grammar_rows('a', 'S = .', concat('/', uuid()))"):
        with pytest.raises(Exception, match="unknown type|xpath|constant"):
            spark.sql(f"SELECT * FROM {bad}").collect()
