"""Joins by ranges, stores by path and gapless numbers, against plain forms of the same."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arbolith.functions.numbering import carried, gapless
from arbolith.model import FIELDS
from arbolith.plans import containment, lookup, summary, twig, xpath_frames
from arbolith.session import ship
from arbolith.sources import readers


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def brute_pairs(points, spans):
    return sorted((p, s) for p, (k, at) in points.items() for s, (q, a, b) in spans.items() if k == q and a <= at <= b)


def test_numbers_in_ranges_by_brute_force(spark):
    r = random.Random(2)
    points = {i: (r.choice([1, 2]), r.randrange(20000)) for i in range(400)}
    spans = {i: (r.choice([1, 2, 3]), a := r.randrange(20000), a + r.choice([-1, 0, 1, 31, 32, 33, 255, 256, 257, 2048, 2049, 15000])) for i in range(200)}
    p = spark.createDataFrame([(i, *x) for i, x in points.items()], "p long, doc long, at int")
    s = spark.createDataFrame([(i, *x) for i, x in spans.items()], "s long, doc long, a int, b int")
    got = containment.pairs(p, F.col("at"), s, F.col("a"), F.col("b"), ["doc"]).select("p", "s").collect()
    assert sorted(map(tuple, got)) == brute_pairs(points, spans)


def test_one_large_document_is_many_tasks_work(spark):
    """A root over all nodes, elements over 64 and leaves: no partition gets over 2 % of the pairs."""
    n = 150_000
    points = spark.range(n).selectExpr("1L doc", "int(id) at")
    spans = spark.range(0, n, 64).selectExpr("1L doc", "int(id) a", "int(id + 63) b").unionByName(spark.range(1).selectExpr("1L doc", "0 a", f"{n - 1} b"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        found = containment.pairs(points, F.col("at"), spans, F.col("a"), F.col("b"), ["doc"]).groupBy(F.spark_partition_id().alias("task")).count()
        counts = [r["count"] for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(counts) == 2 * n and max(counts) < 0.02 * 2 * n


def test_gapless_numbers_and_sums(spark, tmp_path):
    r = random.Random(4)
    values = r.sample(range(10**6), 3000)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v long, w long").repartition(7)
    rows = gapless(df, "n", f"file://{tmp_path}/a", F.asc("v"), start=5, parts=13).collect()
    assert sorted((x.n, x.v) for x in rows) == list(enumerate(sorted(values), 5))
    parted = df.withColumn("part", F.expr("int(v div 100000)"))
    before, total = {}, 0
    for v in sorted(values):
        before[v], total = total, total + v % 7
    assert {x.v: x.s for x in carried(parted, "part", [F.asc("v")], {"s": F.col("w")}).collect()} == before
    assert gapless(df.limit(0), "n", f"file://{tmp_path}/b", F.asc("v")).collect() == []


BOOKS = [
    (1, "<shop><book id='1' lang='en'><title>A</title><price>5</price></book><book id='2'><title>B <b>bold</b></title><price>50</price><note><title>C</title></note></book><cd id='3'/></shop>"),
    (2, "<shop><book id='4'><title/></book></shop>"),
    (3, "<other><title>D</title></other>"),
]
PATHS = [
    "/shop/book/@id", "//book[price > 10]/title | //cd", "//book[not(price)]/@id", "/shop/*[2]/@*", "//b/ancestor::book/@id",
    "//title[. = 'A']/following::price", "//cd/preceding-sibling::book[1]/@id", "//book[title/b and count(.//title) = 2]/price/..", "/none/at/all", "//book/descendant-or-self::*", "//note/preceding::title",
]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    ship(spark)
    where = f"file://{tmp_path_factory.mktemp('store')}"
    nodes = readers.stored(readers.nodes(spark.createDataFrame(BOOKS, "doc_id long, t string"), "t", kind="xml"), f"{where}/plain")
    summary.store(nodes, f"{where}/by_path")
    return nodes, summary.Store(spark, f"{where}/by_path")


@pytest.mark.parametrize("path", PATHS)
def test_a_store_gives_what_the_whole_table_gives(both, path):
    nodes, store = both
    want = sorted((r.doc_id, r.pre) for r in xpath_frames.select(nodes, path).collect())
    assert sorted((r.doc_id, r.pre) for r in store.select(path).collect()) == want


def test_values_from_a_store(both):
    nodes, store = both
    for e in ("count(//book)", "sum(//price)", "string(//title)", "concat(//book/@id, '-', //title)", "boolean(//cd)", "name(/*)"):
        assert sorted(map(tuple, store.evaluate(e).collect())) == sorted(map(tuple, xpath_frames.evaluate(nodes, e).collect()))
    assert sorted(r.text for r in store.string_values("//title").collect()) == ["", "A", "B bold", "C", "D"]


def test_a_scan_of_a_store_reads_the_paths_it_needs(both, spark):
    """The filter on numbers of paths reaches the scan, and nodes of other paths aren't read."""
    nodes, store = both
    found = store.select("/shop/book/@id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "EqualTo(path_id" in scan and "Join" not in plan
    assert store.pruned("/shop/book/@id").count() == 3 < nodes.count()
    assert store.pruned("//book[price > 10]/title", False).filter("kind = 'attribute'").count() == 0
    assert {r.path for r in store.paths.collect()} == {r.path for r in nodes.select("path").collect()}


def test_numbers_of_paths_follow_their_order(both):
    rows = sorted(both[1].paths.collect(), key=lambda r: r.path_id)
    assert [r.path_id for r in rows] == list(range(len(rows))) and [(r.path, r.kind) for r in rows] == sorted((r.path, r.kind) for r in rows)
    assert both[1].nodes.columns == ["path_id", *FIELDS]


PATTERNS = [
    "/shop/book[title and price]/@id", "//book[price > 10]/title", "//book[not(price)]/@id", "//book[@lang='en' or note]//title", "//*[title = 'A']/price/text()", "//book[title/b]", "//book[note/title = 'C' and not(@lang)]/note",
    "//book[title != 'A']/@id", "/shop[cd]/book[2 < price]", "//shop[book[not(note)]]//title[b or . = 'x']", "//book//title",
]


def test_branches_matched_in_one_pass(both, spark, tmp_path):
    """Also with buckets of four numbers, so that most nodes go beyond theirs."""
    nodes, _ = both
    for i, path in enumerate(PATTERNS):
        if ". = 'x'" in path:
            with pytest.raises(twig.XPathError):
                twig.compiled(path)
            continue
        want = sorted((r.doc_id, r.pre) for r in xpath_frames.select(nodes, path).collect())
        plain = twig.match(nodes, path, split=False)
        assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert sorted((r.doc_id, r.pre) for r in plain.collect()) == want, path
        assert sorted((r.doc_id, r.pre) for r in twig.match(nodes, path, f"file://{tmp_path}/{i}", width=4, split=True).collect()) == want, path


def test_patterns_on_random_trees(spark, tmp_path):
    r = random.Random(9)

    def tree(depth: int) -> str:
        n = r.choice("abc")
        inner = "".join(tree(depth - 1) for _ in range(r.randrange(4))) if depth else ""
        return f"<{n}" + (f" k='{r.randrange(3)}'" if r.random() < 0.5 else "") + f">{r.choice(['', '1', '7'])}{inner}</{n}>"

    rows = [(i, f"<a>{tree(5)}{tree(4)}</a>") for i in range(12)]
    nodes = readers.stored(readers.nodes(spark.createDataFrame(rows, "doc_id long, t string"), "t", kind="xml"), f"file://{tmp_path}/nodes")
    for i, path in enumerate(["//a[b//c and @k=1]//b", "//a[not(.//b[c])]/c/@k", "//b[a/@k or c > 3]/a//c"]):
        path = path.replace(".//b", "b")
        want = sorted((x.doc_id, x.pre) for x in xpath_frames.select(nodes, path).collect())
        for width in (3, 17, 1000):
            assert sorted((x.doc_id, x.pre) for x in twig.match(nodes, path, f"file://{tmp_path}/{i}-{width}", width=width).collect()) == want, (path, width)


@pytest.mark.parametrize("keys", [lookup.KEYS, 0])
def test_values_looked_up_in_other_documents(spark, tmp_path, monkeypatch, keys):
    """The first node with a key counts, whether what is looked up in is broadcast or not."""
    monkeypatch.setattr(lookup, "KEYS", keys)
    asked = spark.createDataFrame([(1, "<r><k>a</k><k>b</k></r>"), (2, "<r><k>a</k><k>none</k><k/></r>")], "doc_id long, t string")
    other = spark.createDataFrame([(5, "<s><x i='a'><v>late</v></x></s>"), (4, "<s><x i='b'/><x i='a'><v>first</v></x><x i='a'><v>second</v></x><x><v>no key</v></x></s>")], "doc_id long, t string")
    left, right = (readers.stored(readers.nodes(t, "t", kind="xml"), f"file://{tmp_path}/{n}") for n, t in (("l", asked), ("r", other)))
    found = lookup.lookup(left, "//k", right, "//x", "@i", "v")
    assert sorted(((r.doc_id, r.key, r.value) for r in found.collect()), key=str) == [(1, "a", "first"), (1, "b", ""), (2, "", None), (2, "a", "first"), (2, "none", None)]
    assert ("BroadcastHashJoin [key" in found._jdf.queryExecution().executedPlan().toString()) is (keys > 0)
