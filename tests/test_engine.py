"""Parsers, XPath, changes, grammars, stylesheets, schemas and writers on small hand-made documents."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbolith.functions.trimming import trim
from arbolith.grammar import registry
from arbolith.grammar.earley import Failure, kept_characters
from arbolith.model import FIELDS, build, shred
from arbolith.operators import measure, mutate
from arbolith.plans import trees, xpath, xpath_frames, xpath_tree, xsd, xslt
from arbolith.session import ship
from arbolith.sinks import brace_out, json_out, markup, writers
from arbolith.sinks.brace_out import Printer, quote_compact
from arbolith.sources import brace, detect, json_tree, readers
from arbolith.sources.brace import ParseError
from arbolith.sources.markup import parse_html, parse_xml

COMPACT, PRETTY = Printer(compact=True).render, Printer().render


# -- brace syntax


def test_tokens_and_their_places():
    got = brace.tokenize("a:root(xmlns:a = z://a\n       xmlns = q)\n{ x='1' }")
    assert got[:3] == [("element_ns", "a", 1, 1), ("ns_colon", ":", 1, 2), ("element_name", "root", 1, 3)]
    assert ("ns_declaration", "xmlns", 2, 8) in got and ("element_value_quote", "'1'", 3, 5) in got


def test_every_character_is_in_a_token():
    for s in ("a{b=1 c(d='x y')='z' // hi\n &nbsp; }", "///* c *///*d*///x", "k=( 'a' &#10; 'b' )", "!DOCTYPE=html html"):
        assert "".join(t for _, t, _, _ in brace.tokenize(s)) == s


@pytest.mark.parametrize(
    ("text", "message", "place"),
    [("a{b", "brace is not closed", (1, 2)), ("a}", "unexpected closing brace", (1, 2)), ("a='x", "quote is not closed", (1, 3)), ("a=\t1", "tab", (1, 3)), ("a(b=1 b=2)", "twice", (1, 7)), ("a='''x''''", "too many quotes", (1, 7)), ("x\n /* y", "comment is not closed", (2, 2))],
)
def test_errors_say_where(text, message, place):
    with pytest.raises(ParseError, match=message) as e:
        brace.parse(text)
    assert (e.value.line, e.value.column) == place


def test_trimming():
    assert trim("\n  a\n    b\n  ") == "a\n  b"
    assert trim("a\n   b\n  c") == "a\n b\nc"
    assert trim("\n\n") == "\n" and trim("a\n\n\n") == "a\n\n" and trim("  x  ") == "  x  "
    assert trim("\n    a\n  ", brace=True) == "  a"


@pytest.mark.parametrize(
    ("text", "compact", "pretty"),
    [
        ("harbour { }", "harbour", "harbour\n"),
        ("ship{hull{mast}}", "ship{hull{mast}}", "ship {\n    hull {\n        mast\n    }\n}\n"),
        ("port{pier='two words' depth=12 berth=A}", "port{pier='two words'depth=12 berth=A}", "port {\n    pier  = 'two words'\n    depth = 12\n    berth = A\n}\n"),
        ("log(day=3){note='first\nsecond'}", "log(day=3){note=('first'&#10;'second')}", "log(day = 3)\n{\n    note = 'first\n            second'\n}\n"),
        ("!DOCTYPE = html html{p=x}", "!DOCTYPE=html html{p=x}", "!DOCTYPE = html\nhtml {\n    p = x\n}\n"),
        ("k = (  'a' &nbsp; 'b' )", "k=('a'&nbsp;'b')", None),
    ],
)
def test_printing(text, compact, pretty):
    doc = brace.parse(text)
    assert compact in (None, COMPACT(doc)) and pretty in (None, PRETTY(doc))
    assert COMPACT(brace.parse(COMPACT(doc))) == COMPACT(doc) and COMPACT(brace.parse(PRETTY(doc))) == COMPACT(doc)


def test_comments_of_many_lines():
    doc = brace.parse("crate{/*two\nlines*/ n=1}")
    assert PRETTY(doc) == "crate {\n    /* two\n       lines */\n    n = 1\n}\n" and COMPACT(doc) == "crate{/*two*/*lines*/n=1}"


def test_compact_quotes():
    assert quote_compact("\na line\n") == "(&#10;'a line'&#10;)" and quote_compact("x") == "'x'" and quote_compact("it's") == "\"it's\""


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'\" \n&;/*{}()=é", max_size=20))
def test_any_text_survives_brace_syntax(value):
    from arbolith.model import document, element, text

    doc = document(element("k", text(value)))
    for show in (COMPACT, PRETTY):
        assert brace.parse(show(doc)).children[0].text() == value


# -- JSON


@pytest.mark.parametrize(
    "text",
    ["{}", "true", "null", '"x"', "[1,2.30,1e-5,-0.10]", '{"a":[1,{"b":"true"},[]],"c d":{},"n":null,"s":"12"}', '{"_":"person","_x":"1","age":3}', '{"a":{"_b":null,"k":"v"}}', '{"p:q":{"_xmlns:p":"u","x":1}}', '{"t":{"|":"bare","x":1}}'],
)
def test_json_round_trip(text):
    assert json_out.render(json_tree.parse(text)) == text


def test_json_keeps_repeated_keys_and_marks_strings():
    assert COMPACT(json_tree.parse('{"x":1,"x":"2"}')) == "_{x=1 x(S)=2}"
    assert json_out.render(json_tree.parse('{"x":1,"x":2}')) == '{"x[0]":1,"x[1]":2}'
    with pytest.raises(ParseError):
        json_tree.parse('{"a":1\t}')


# -- XML and HTML


def test_xml_keeps_unknown_entities_and_merges_cdata():
    doc = parse_xml('<a x="1" xmlns:q="u"><q:b>t&amp;u&foo;</q:b><!--c--><![CDATA[<z>]]></a>')
    assert markup.xml(doc, False) == '<a x="1" xmlns:q="u"><q:b>t&amp;u&foo;</q:b><!--c-->&lt;z&gt;</a>'


def test_html_is_repaired():
    doc = parse_html("<!DOCTYPE html><title>T</title><p>one<p>two<ul><li>a<li>b</ul><script>x='</p>'</script><br>&amp;")
    assert COMPACT(doc) == "!DOCTYPE=html html{head{title=T}body{p=one p=two ul{li=a li=b}script='x=\\'</p>\\''br '&'}}".replace("'x=\\'</p>\\''", "\"x='</p>'\"")
    with pytest.raises(ParseError):
        parse_html("")


def test_path_lines():
    doc = brace.parse("fleet(year=1) { tug 'in dock' ferry(lit)=north 'at sea' }")
    assert markup.clines(doc) == '/fleet/@year="1"\n/fleet/tug=""\n/fleet="in dock"\n/fleet/ferry/@lit=""\n/fleet/ferry="north"\n/fleet="at sea"\n'


# -- tables of nodes

SOURCES = ["a(id=1){b(x=1)=one b(x=2)=two c{b(x=3)='3' d{e=5 e=7}} /*hi*/ &foo; 'tail' b=four}", "a{b=4 b=5 c{b=9} &foo; &#65;}"]
TREES = [brace.parse(s, merge=False) for s in SOURCES]


@pytest.fixture(scope="module")
def nodes(spark):
    ship(spark)
    df = spark.createDataFrame(list(enumerate(SOURCES)), "doc_id long, t string")
    return readers.nodes(df, "t", kind="brace", merge=False).cache()


def numbers(tree):
    out, stack = {}, list(reversed(tree.children))
    while stack:
        n = stack.pop()
        out[id(n)] = len(out)
        stack += reversed([*n.attrs, *n.children])
    return out


@pytest.mark.parametrize("path", ["/a/b", "//b[2]", "/a/b[last()]", "//b[@x='2']", "//b[not(@x)]", "//e/..", "//e/ancestor::*", "//d/preceding::b", "/a/c/following-sibling::node()", "//b[. > 4]", "//b[@x=../c/b/@x]", "//e | //d", "//c[count(.//e)=2]", "(//b)[2]", "//b[contains(.,'o')]", "//@x", "//c[.//e!=7]"])
def test_tables_and_trees_give_the_same_nodes(nodes, path):
    got = sorted((r.doc_id, r.pre) for r in xpath_frames.select(nodes, path).collect())
    want = [(i, numbers(t)[id(n)]) for i, t in enumerate(TREES) for n in xpath_tree.evaluate(xpath.parse(path), xpath_tree.Context(t))]
    assert got == sorted(want)


def test_xpath_errors():
    for bad in ("//[", "a b", "foo::a", "1 +"):
        with pytest.raises(xpath.XPathError):
            xpath.parse(bad)


@pytest.mark.parametrize(
    ("change", "want"),
    [
        (lambda n: mutate.select(n, "//b"), ["b=four b(x=3)=3 b(x=2)=two b(x=1)=one", "b=9 b=5 b=4"]),
        (lambda n: mutate.select(n, "//@x", "document"), ["x=1 x=2 x=3", ""]),
        (lambda n: mutate.delete(n, "//c | //@id"), ["a{b(x=1)=one b(x=2)=two /*hi*/&foo;'tail'b=four}", "a{b=4 b=5 &foo;&#65;}"]),
        (lambda n: mutate.replace_argument(n, "//c=x=y"), ["a(id=1){b(x=1)=one b(x=2)=two c=x=y /*hi*/&foo;'tail'b=four}", "a{b=4 b=5 c=x=y &foo;&#65;}"]),
        (lambda n: mutate.replace_entity(n, "foo", "F"), ["a(id=1){b(x=1)=one b(x=2)=two c{b(x=3)=3 d{e=5 e=7}}/*hi*/'Ftail'b=four}", "a{b=4 b=5 c{b=9}'F'&#65;}"]),
        (lambda n: mutate.substitute_entity(mutate.delete_entity(n, "foo")), ["a(id=1){b(x=1)=one b(x=2)=two c{b(x=3)=3 d{e=5 e=7}}/*hi*/'tail'b=four}", "a{b=4 b=5 c{b=9}'A'}"]),
        (lambda n: mutate.add_root(mutate.add(mutate.select(n, "/a/c"), "z{y}"), "top"), ["top{c{b(x=3)=3 d{e=5 e=7}}z{y}}", "top{c{b=9}z{y}}"]),
        (lambda n: mutate.set_attribute(mutate.select(n, "//d | //c"), "//*", "v", "1"), ["d(v=1){e(v=1)=5 e(v=1)=7}c(v=1){b(x=3 v=1)=3}", "c(v=1){b(v=1)=9}"]),
    ],
)
def test_changes_keep_numbers_right(nodes, change, want):
    rows = [r.asDict() for r in change(nodes).collect()]
    for i in (0, 1):
        own = [r for r in rows if r["doc_id"] == i]
        tree = build(own)
        assert COMPACT(tree) == want[i]
        made = {t[1]: t for t in shred(tree, i)}
        for r in own:
            assert [r[f] for f in FIELDS if f not in ("ns_uri",)] == [v for f, v in zip(FIELDS, made[r["pre"]], strict=True) if f != "ns_uri"]


@pytest.mark.parametrize(
    ("path", "change"),
    [
        ("select", lambda t: t.select("//b")), ("attributes", lambda t: t.select("//@x", "document")), ("delete", lambda t: t.delete("//c | //@id")), ("bad path", lambda t: t.delete("//[")),
        ("replace", lambda t: t.replace_argument("//c=x=y")), ("replace attribute", lambda t: t.replace("//@x", "9")), ("entity", lambda t: t.replace_entity("foo", "F")), ("no entity", lambda t: t.substitute_entity().delete_entity("foo")),
        ("chain", lambda t: t.select("/a/c").add("z{y}").add_root("top")), ("set", lambda t: t.select("//d | //c").set_attribute("//*", "v", "1")), ("tree", lambda t: t.replace_entity_with_tree("foo", "q(k=1){x y=2}")),
    ],
)
def test_one_pass_gives_what_tables_of_nodes_give(spark, nodes, path, change):
    """The same chain of steps over trees, in one Arrow stage without a shuffle, and over rows of nodes."""
    names = {"select": mutate.select, "delete": mutate.delete, "replace": mutate.replace, "replace_argument": mutate.replace_argument, "replace_entity": mutate.replace_entity, "delete_entity": mutate.delete_entity, "substitute_entity": mutate.substitute_entity, "add": mutate.add, "add_root": mutate.add_root, "set_attribute": mutate.set_attribute, "replace_entity_with_tree": mutate.replace_entity_with_tree}

    class Tables:
        def __init__(self, rows):
            self.rows = rows

        def __getattr__(self, name):
            return lambda *a: Tables(names[name](self.rows, *a))

    df = spark.createDataFrame(list(enumerate(SOURCES)), "doc_id long, t string")
    one = change(trees.of(df, "t", kind="brace", merge=False)).nodes()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    place = lambda rows: sorted([tuple(r[f] for f in FIELDS if f != "ns_uri") for r in rows], key=lambda r: r[:2])
    assert place(one.collect()) == place(change(Tables(nodes)).rows.collect())


def test_what_is_read_off_trees(spark):
    ship(spark)
    rows = [(1, "a{b=1 b=2 c(k=x)=' t '}", "u"), (2, "a", "v"), (3, None, "w"), (4, "a{", "z")]
    t = trees.of(spark.createDataFrame(rows, "doc_id long, t string, tag string"), "t", kind="brace", keep=["tag"])
    assert [tuple(r) for r in t.values("//b").collect()] == [(1, "u", "1"), (1, "u", "2")]
    assert [(r.doc_id, r.pre, r.value) for r in t.found("//b | //@k").collect()] == [(1, 1, "1"), (1, 3, "2"), (1, 6, "x")]
    assert [(r.doc_id, r.value) for r in t.evaluate("count(/a/b)", "double").collect()] == [(1, 2.0), (2, 0.0), (4, 0.0)]
    assert [(r.doc_id, r.line) for r in t.foreach("/a/b", "${..}:${.}").collect()] == [(1, "b:1"), (1, "b:2")]
    assert [(r.doc_id, r.valid) for r in t.validate(XS % ("", "xs:element(name=a)")).collect()] == [(1, True), (2, True), (4, False)]
    assert {r.kind for r in t.nodes().filter("doc_id = 4").collect()} == {"error"}
    assert t.select("//none").nodes().count() == 0
    from arbolith.plans.pipeline import Pipeline

    p = Pipeline().delete("//b[1]").add_root("top")
    assert [r.text for r in p.render(spark.createDataFrame(rows[:2], "doc_id long, t string, tag string"), "t", "brace", to_options={"compact": True}).collect()] == ["top{a{b=2 c(k=x)=' t '}}", "top{a}"]
    assert p.explain() == "delete //b[1] -> add-root top"
    forced = trees.of(spark.createDataFrame([(1, "a{}"), (2, "<a/>")], "doc_id long, t string"), "t", kind="xml", forced=True).nodes().collect()
    assert {(r.doc_id, r.kind) for r in forced} == {(1, "error"), (2, "element")}


def fewest_gone(machine, text):
    """By trying every set of characters to take out, small ones first."""
    from itertools import combinations

    for k in range(len(text) + 1):
        for gone in combinations(range(len(text)), k):
            try:
                machine.recognise("".join(c for i, c in enumerate(text) if i not in gone))
                return k
            except Failure:
                pass
    return None


@pytest.mark.parametrize("grammar", ["X+, X = 'a','b' | 'c'", "X = 'abc', Y?. Y = ['a'-'b'], Y | 'c'.", "S = '(', S, ')' | 'a'."])
def test_recovery_takes_out_the_fewest(grammar):
    import random

    grammar = grammar if grammar.endswith(".") else "S = X+. X = 'a','b' | 'c'."
    machine, r = registry.machine(grammar), random.Random(1)
    for text in ["acccccb", "", *("".join(r.choice("abc()") for _ in range(r.randint(1, 8))) for _ in range(40))]:
        kept = kept_characters(machine, text)
        least = fewest_gone(machine, text)
        assert (None if kept is None else len(text) - len(kept)) == least, text
    long = "c" * 30 + "!" * 25 + "c" * 5
    if grammar.startswith("S = X+"):
        assert registry.parse_text(grammar, long, recover=True).children[0].attr("skipped").value == "25"


def test_files_and_lines_have_ids_of_their_places(spark, tmp_path):
    ship(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\ufeffk=1", encoding="utf-8")
    (tmp_path / "in/b.txt").write_text("x{y}\nz", encoding="utf-8")
    (tmp_path / "in/w.txt").write_text("k=1", encoding="utf-16")
    path = f"file://{tmp_path}/in"
    first, again = ({r.source: (r.doc_id, r.content_type) for r in readers.files(spark, path).collect()} for _ in range(2))
    assert first == again and len({i for i, _ in first.values()}) == 3 and sorted(t for _, t in first.values()) == ["brace", "brace", "utf-16 is not supported"]
    assert sorted(r.raw for r in readers.lines(spark, f"{path}/b.txt").collect()) == ["x{y}", "z"]
    assert readers.empty(spark).count() == 1 and [r.raw for r in readers.literal(spark, "a", "b").collect()] == ["a", "b"]


def test_typed_values_and_templates(spark, nodes):
    from pyspark.sql import functions as F

    texts = ["0x1F", "077", "12abc", "abc", "", None, "-5", "09"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.v for r in df.select(measure.c_integer(F.col("t")).alias("v")).collect()] == [31, 63, 12, 0, 0, 0, -5, 0]
    lines = measure.foreach(nodes, "//b[@x]", "${..}:${@x}=${.}").orderBy("pre").collect()
    assert [r.line for r in lines] == ["b:1=one", "b:2=two", "b:3=3"]


def test_statistics_of_html(spark):
    ship(spark)
    html = '<!DOCTYPE html><html lang="sv"><head><!--note to self--><script>run(1)</script></head><body class="wide"><p>tide</p><p>at \'noon\'</p></body></html>'
    df = spark.createDataFrame([(1, html)], "doc_id long, t string")
    s = measure.statistics(readers.nodes(df, "t", kind="html"), readers.docs(df, "t")).first()
    names, attributes = ["html", "head", "script", "body", "p", "p"], {"lang": "sv", "class": "wide"}
    assert (s.size_source, s.num_elements, s.size_element_names) == (len(html), len(names), sum(map(len, names)))
    assert (s.num_attributes, s.size_attribute_names, s.size_attribute_content) == (2, sum(map(len, attributes)), sum(map(len, attributes.values())))
    assert (s.num_text_nodes, s.size_text_nodes, s.num_cdata_nodes, s.size_cdata_nodes) == (2, len("tideat 'noon'"), 1, len("run(1)"))
    assert (s.num_text_nodes_with_single_quotes, s.num_text_nodes_with_no_quotes, s.num_comments, s.size_comments, s.size_doctype) == (1, 1, 1, len("note to self"), 4)
    assert s.sum_meta == s.size_element_names + s.size_attribute_names + s.size_attribute_content + 4 and s.sum_text == s.size_text_nodes


def test_bad_documents_become_error_rows(spark):
    ship(spark)
    df = spark.createDataFrame([(1, "{"), (2, '{"a":1}'), (3, None)], "doc_id long, t string")
    rows = readers.nodes(df, "t", kind="json").collect()
    assert {(r.doc_id, r.kind) for r in rows} == {(1, "error"), (2, "element"), (2, "text")}
    assert {r.text for r in writers.render(readers.nodes(df.filter("doc_id = 2"), "t"), "json").collect()} == {'{"a":1}'}


# -- grammars


@pytest.mark.parametrize(
    ("grammar", "text", "want"),
    [
        ("tide = level, mark. level = #34. mark = #6d.", "4m", "tide{level=4 mark=m}"),
        ("berth : side?, number, light?. side: 'L' | 'R'. number: ['0'-'9']+. light: '*'.", "R12", "berth{side=R number=12}"),
        ("berth : side?, number, light?. side: 'L' | 'R'. number: ['0'-'9']+. light: '*'.", "7*", "berth{number=7 light=*}"),
        ("S = ^x, @y, -z, +'in'. x='1'. y='2'. z='3'.", "123", "S(y=2){x=1 '3in'}"),
        ("S = n>num++-','. n=['0'-'9']+.", "1,22", "S{num=1 num=22}"),
        ("S = A | B. A =< ['a'-'z']+. B = ['a'-'z']+.", "abc", "S{B=abc}"),
        ('word = !"under", [L]+.', "upper", "word=upper"),
        ("ixml:data/csv", 'a,b\n"x,""q""",2\n', "table{tr{td=a td=b}tr{td='x,\"q\"'td=2}}"),
        ("ixml:data/scsv", "a;;c", "table{tr{td=a td td=c}}"),
        ("ixml:data/tsv", "a b\tc\n1\t2", "table{tr{td='a b'td=c}tr{td=1 td=2}}"),
        ("ixml:conf/crontab", "# nightly\nSHELL = /bin/sh\n5 4 * Jan 0 run --all", "crontab{comment=' nightly'variable{name=SHELL value=/bin/sh}line{minute=5 hour=4 day_of_month=* month_of_year=Jan day_of_week=0 command='run --all'}}"),
        ("ixml:conf/crontab", "@daily  tidy up\n*/5,7-9 0 1 * Mon-Fri  run\n\nMAILTO=\n", "crontab{line{every=daily command='tidy up'}line{minute=*/5,7-9 hour=0 day_of_month=1 month_of_year=* day_of_week=Mon-Fri command=run}variable{name=MAILTO}}"),
        ("x = ~[#a | #d]*.", "ab", "x=ab"),
        ("x = ['a'-'c' | Nd; '-']+.", "b7-", "x=b7-"),
        (
            "ixml:measurement/metar",
            "SPECI KJFK 121251Z 18004KT 150V220 1 1/2SM R04R/P6000VM0600U FG VV002 12/M01 A2992 RETS BECMG FM1300 9999 NSC RMK AO2",
            "weather_report{report_type=SPECI icao_airport_code=KJFK time_of_observation{month=12 time{hour=12 minute=51}time_zone=Z}wind{wind_direction{degrees=180 speed{value=04 unit=KT}}}wind{wind_variation{from_degrees=150 to_degrees=220}}visibility{miles='1 1/2'}runway_visual_range{runway=04R range=6000 below=less range=0600 status=rising}weather{observation{type=FG type-info=fog}}clouds{observation{cloud_cover=VV cloud_base=002}}temperature{air_c=12 dewpoint_c=-01}air_pressure{pressure_hg=2992}recent_weather{chrct=TS chrct-info=thunderstorms}trend{view_becoming{at=FM1300 meters=9999 clouds{observation{cloud_cover=NSC}}}}remark=AO2}",
        ),
        ("ixml:conf/yamlsubset", "port:\n  name: Vik\n  piers:\n    - north\n    - south\ndepth: 12\n", "_{obj(key=port){kv(key=name)=Vik obj(key=piers){list(A=''){li=north li=south}}}kv(key=depth)=12}"),
        (
            "ixml:measurement/metar",
            "METAR ESSA 041620Z AUTO VRB12G25KT 9999 -SHRA OVC050CB M04/07 Q1020 NOSIG=",
            "weather_report{report_type=METAR icao_airport_code=ESSA time_of_observation{month=04 time{hour=16 minute=20}time_zone=Z}observation_type=AUTOMATIC wind{wind_direction{variable=VRB speed{value=12 gusty=25 unit=KT}}}visibility{meters=9999}weather{observation{intensity=light chrct=SH chrct-info=showers type=RA type-info=rain}}clouds{observation{cloud_cover=OVC cloud_base=050 cloud_type=CB}}temperature{air_c=-04 dewpoint_c=07}air_pressure{pressure_hpa=1020}trend=NOSIG}",
        ),
    ],
)
def test_grammars(grammar, text, want):
    assert COMPACT(registry.parse_text(grammar, text)) == want


def test_ambiguity_and_failure():
    g = "tow = rope, hook. rope = '-'+. hook = '-'*, 'J'."
    every = registry.parse_text(g, "--J", every=True)
    assert sorted(COMPACT(build_one(c)) for c in every.children[0].children) == ["tow{rope=- hook=-J}", "tow{rope=-- hook=J}"]
    assert registry.parse_text(g, "--J").children[0].attr("state").value == "ambiguous"
    with pytest.raises(Failure):
        registry.machine(g).parse("--K")
    failed = registry.parse_text('word = !"under", [L]+.', "underway")
    assert [c.text() for c in failed.children[0].children[1:]] == ["1", "1", "1"]
    assert registry.parse_text("ixml:core/ixml", registry.GRAMMARS["core/ixml"]).children[0].name == "ixml"


def build_one(node):
    from arbolith.model import document

    return document(node)


# -- stylesheets and schemas


XSL = "xsl:stylesheet(version=1.0 xmlns:xsl = http://www.w3.org/1999/XSL/Transform) { %s }"


def styled(sheet, doc, **options):
    others = {k: brace.parse(v) for k, v in options.pop("others", {}).items()}
    return COMPACT(xslt.transform(xslt.compile(brace.parse(XSL % sheet), others), doc, documents=others, **options))


def test_stylesheet_looks_up_in_another_document():
    sheet = "xsl:variable(name=t select=\"document('tides')\") xsl:template(match = /days) { xsl:apply-templates(select=d) } xsl:template(match=d) { xsl:variable(name=k select=@on) high(on='{$k}') { xsl:value-of(select='$t/tides/at[@on=$k]/h') ' m' } }"
    assert styled(sheet, brace.parse("days{d(on=2) d(on=1)}"), others={"tides": "tides{at(on=1){h=3}at(on=2){h=5}}"}) == "high(on=2)='5 m'high(on=1)='3 m'"


def test_stylesheets_import_and_include():
    """What is imported gives way to a sheet's own templates, which can call it; what is included counts as its own."""
    base = XSL % "xsl:template(match=a) { 'base ' } xsl:template(match=b) { 'b ' } xsl:param(name=n select=1)"
    more = XSL % "xsl:template(match=c) { 'c ' xsl:value-of(select='$n') }"
    sheet = "xsl:import(href=base) xsl:include(href=more) xsl:template(match=/r) { o { xsl:apply-templates } } xsl:template(match=a) { 'own ' xsl:apply-imports }"
    doc = brace.parse("r{a b c}")
    assert styled(sheet, doc, others={"base": base, "more": more}) == "o='own base b c 1'"
    assert styled(sheet, doc, others={"base": base, "more": more}, params={"n": xslt.Expression("count(/r/*)")}) == "o='own base b c 3'"
    assert styled(sheet, doc, others={"base": base, "more": more}, params={"n": "count(/r/*)"}) == "o='own base b c count(/r/*)'"
    for missing in ("xsl:import(href=gone)", "xsl:include(href=gone)"):
        with pytest.raises(xslt.StylesheetError):
            styled(missing, doc)
    with pytest.raises(xslt.StylesheetError):
        styled("xsl:include(href=loop)", doc, others={"loop": XSL % "xsl:include(href=loop)"})


def test_aliases_of_namespaces():
    sheet = XSL.replace("version=1.0", "version=1.0 xmlns:out = z://o xmlns:x = z://x") % "xsl:namespace-alias(stylesheet-prefix=x result-prefix=out) xsl:template(match=/r) { x:made { x:inner } }"
    assert COMPACT(xslt.transform(xslt.compile(brace.parse(sheet)), brace.parse("r"))) == "out:made(xmlns:out=z://o){out:inner}"


@pytest.mark.parametrize(
    ("value", "pattern", "want"),
    [(1234567.891, "#,##0.00", "1,234,567.89"), (0.5, "#.##", ".5"), (0, "#", "0"), (-7, "0;(0)", "(7)"), (-7, "00", "-07"), (0.256, "0.#%", "25.6%"), (float("nan"), "0", "NaN"), (float("inf"), "$0", "$Infinity"), (1.5, "0.000", "1.500"), (12, "'n'0", "'n'12")],
)
def test_numbers_by_patterns(value, pattern, want):
    assert xpath_tree.format_number(value, pattern) == want


def test_decimal_formats():
    sheet = "xsl:decimal-format(name=d decimal-separator=',' grouping-separator='.') xsl:template(match=/r) { xsl:value-of(select=\"format-number(., '#.##0,0', 'd')\") }"
    assert styled(sheet, brace.parse("r=1234.56")) == "'1.234,6'"
    with pytest.raises(xslt.StylesheetError):
        styled("xsl:template(match=/r) { xsl:value-of(select=\"format-number(., '0', 'none')\") }", brace.parse("r=1"))


XS = "xs:schema(xmlns:xs = http://www.w3.org/2001/XMLSchema %s) { %s }"


def wrong(schema, text, declarations=""):
    return xsd.validate(xsd.compile(brace.parse(XS % (declarations, schema))), brace.parse(text))


def test_keys_of_a_schema():
    row = "xs:element(name=%s minOccurs=0 maxOccurs=unbounded) { xs:complexType { xs:attribute(name=id type=xs:int) } }"
    rules = "xs:key(name=k) { xs:selector(xpath=s) xs:field(xpath=@id) } xs:keyref(name=f refer=k) { xs:selector(xpath=.//v) xs:field(xpath=@id) } xs:unique(name=u) { xs:selector(xpath=v) xs:field(xpath=@id) }"
    schema = f"xs:element(name=r) {{ xs:complexType {{ xs:sequence {{ {row % 's'} {row % 'v'} }} }} {rules} }}"
    assert wrong(schema, "r{s(id=1) s(id=2) v(id=2) v}") == []
    for bad in ("r{s(id=1) s(id=1)}", "r{s}", "r{s(id=1) v(id=3)}", "r{s(id=1) v(id=1) v(id=1)}"):
        assert wrong(schema, bad), bad


def test_namespaces_and_substitution_in_a_schema():
    schema = "xs:element(name=r) { xs:complexType { xs:sequence { xs:element(ref=boat maxOccurs=3) } } } xs:element(name=boat abstract=true) xs:element(name=tug type=xs:int substitutionGroup=boat) xs:element(name=ferry type=xs:string substitutionGroup=tug)"
    assert wrong(schema, "r{tug=1 ferry=x}") == []
    assert wrong(schema, "r{boat}") and wrong(schema, "r{tug=x}") and wrong(schema, "r{raft}")
    spaced = "xs:element(name=r) { xs:complexType { xs:sequence { xs:element(name=e type=xs:int) } } }"
    where = "targetNamespace = z://t elementFormDefault = qualified"
    assert wrong(spaced, "r(xmlns = z://t){e=1}", where) == [] and wrong(spaced, "r{e=1}", where) and wrong(spaced, "t:r(xmlns:t = z://t){e=1}", where)
    anything = "xs:element(name=r) { xs:complexType { xs:sequence { xs:any(namespace = '##other' processContents = skip) } } }"
    assert wrong(anything, "t:r(xmlns:t = z://t){q:e(xmlns:q = z://q)}", "targetNamespace = z://t") == [] and wrong(anything, "t:r(xmlns:t = z://t){t:e}", "targetNamespace = z://t")


def test_unknown_types_are_an_error():
    with pytest.raises(xsd.SchemaError):
        wrong("xs:element(name=r type=xs:integre)", "r=1")
    assert wrong("xs:element(name=r type=xs:gMonthDay)", "r=--02-30") == [] and wrong("xs:element(name=r type=xs:gMonthDay)", "r=--13-01")


def test_schema():
    schema = xsd.compile(brace.parse("xs:schema(xmlns:xs = z://schema) { xs:element(name=o) { xs:complexType { xs:sequence { xs:element(name=n type=xs:string) xs:element(name=c type=xs:int minOccurs=0 maxOccurs=unbounded) } xs:attribute(name=id type=xs:integer use=required) } } }"))
    assert xsd.validate(schema, brace.parse("o(id=1){n=q c=1 c=2}")) == []
    for bad in ("o{n=q}", "o(id=x){n=q}", "o(id=1){n=q c=z}", "o(id=1){c=1}", "o(id=1){n=q z}", "p"):
        assert xsd.validate(schema, brace.parse(bad))


def test_colours_keep_the_text():
    import re

    from arbolith.sinks import coloured

    source = "a(x = '<1>')\n{\n    b = 2 // c\n}\n"
    assert re.sub(r"\x1b\[[0-9;]*m", "", coloured.paint(source)) == source
    assert re.sub("<[^>]*>", "", coloured.paint(source, "html")).replace("&lt;", "<").replace("&gt;", ">") == source
    assert coloured.nearest_256("ff0000") == 196 and "arb-key" in coloured.page(coloured.paint(source, "html"))
    assert "\\arbKey{b}" in coloured.paint(source, "tex")


def test_the_cheapest_parse_is_sought_among_all():
    from arbolith.grammar import registry

    g = "S = A, B. A = ~[]*. B = 'x', ~[]* | C. C =< ~[]*."
    for n in (5, 70, 90):
        root = registry.parse_text(g, "x" + "y" * n).children[0]
        b = next(c for c in root.children if c.name == "B")
        assert not any(c.name == "C" for c in b.children), n
    cut = registry.parse_text("S = A, A, A, A. A = ~[]*.", "y" * 18, every=True).children[0]
    assert cut.name == "AMBIGUOUS" and cut.attr("cut") is not None


@pytest.mark.parametrize(
    ("source", "compact"),
    [
        ("a { /* one */* two */ }", "a{/*one*/*two*/}"),
        ("a {b // x\n c}", "a{b /*x*/c}"),
        ("a(k=&nbsp; l=m; n=o)=p/ q", "a(k=&nbsp;l=m; n=o)=p/ q"),
        ("a=&nbsp; b='c'", "a=&nbsp;b=c"),
    ],
)
def test_compact_form_of_comments_and_entities(source, compact):
    doc = brace.parse(source)
    assert COMPACT(doc) == compact and COMPACT(brace.parse(compact)) == compact


def test_quotes_of_the_other_kind_where_one_stands_at_an_end():
    for text in ("'how\"d'", "'a", "a'", "'\"", "\"'", "''a\"\"b''"):
        shown = brace_out.quoted(text)
        assert brace.unquote(shown) == text
    assert brace_out.quoted("'how\"d'") == '"""\'how"d\'"""'


def test_document_types_keep_their_subsets():
    doc = parse_xml('<!DOCTYPE t [<!ENTITY  name   "N  M">\n<!--x  y--><!ELEMENT t ANY>]>\n<t k="&name;">a&name;b&other;</t>')
    assert doc.children[0].value == 't [\n<!ENTITY name "N  M">\n<!--x  y-->\n<!ELEMENT t ANY>\n]'
    assert [(c.kind, c.name or c.value) for c in doc.children[1].children] == [("text", "a"), ("entity", "name"), ("text", "b"), ("entity", "other")]
    assert markup.xml(doc, False).startswith('<!DOCTYPE t [\n<!ENTITY name "N  M">')
    assert parse_xml("<!DOCTYPE t []><t/>").children[0].value == "t" and parse_xml('<!DOCTYPE t SYSTEM "u"><t/>').children[0].value == 't SYSTEM "u"'


def test_comments_in_json_have_keys_of_their_own():
    doc = parse_xml("<!--lead--><a><!--x--><b/>t<!--y--><c/>u</a><!--p--><!--q-->")
    text = json_out.render(doc)
    assert text == '{"_//[0]":"lead","_":"a","//[0]":"x","b":{},"|[0]":"t","//[1]":"y","c":{},"|[1]":"u","_//[1]":"q","_//[2]":"p"}'
    assert COMPACT(json_tree.parse(text)) == COMPACT(doc) and len(json.loads(text)) == 10


@pytest.mark.parametrize(
    ("facets", "value", "fine"),
    [
        ("xs:pattern(value = '\\p{L}+')", "åb", True),
        ("xs:pattern(value = '[a-z-[aeiou]]+')", "bcd", True),
        ("xs:pattern(value = '[a-z-[aeiou]]+')", "bad", False),
        ("xs:pattern(value = '^a$')", "a", False),
        ("xs:pattern(value = '\\i\\c*')", "x-1", True),
        ("xs:length(value = 2)", "10 20", True),
        ("xs:maxLength(value = 1)", "10 20", False),
        ("xs:enumeration(value = '1 2')", "1  2", True),
    ],
)
def test_facets_of_a_schema(facets, value, fine):
    base = "xs:restriction(base = L)" if "ength" in facets or "enum" in facets else "xs:restriction(base = xs:string)"
    schema = xsd.compile(brace.parse("xs:schema(xmlns:xs = http://www.w3.org/2001/XMLSchema) { xs:simpleType(name = L) { xs:list(itemType = xs:int) } xs:element(name = r) { xs:simpleType { " + base + " { " + facets + " } } } }"))
    doc = parse_xml(f"<r>{value}</r>")
    assert (xsd.validate(schema, doc) == []) is fine


def test_instances_of_a_schema():
    schema = xsd.compile(brace.parse("xs:schema(xmlns:xs = http://www.w3.org/2001/XMLSchema) { xs:element(name = r) { xs:complexType { xs:sequence { xs:element(name = n maxOccurs = unbounded nillable = true type = N) xs:element(name = i minOccurs = 0 maxOccurs = unbounded type = xs:ID) } } } xs:simpleType(name = N) { xs:restriction(base = xs:int) { xs:enumeration(value = 1) xs:enumeration(value = 20) } } }"))
    xsi = "xmlns:xsi='http://www.w3.org/2001/XMLSchema-instance'"
    good = (f"<r {xsi}><n>01</n><n xsi:nil='true'/><n xsi:type='xs:string'>any</n><i>a</i><i>b</i></r>", "<r><n> 20 </n></r>")
    bad = (f"<r {xsi}><n xsi:nil='true'>1</n></r>", f"<r {xsi}><n>1</n><i xsi:nil='true'/></r>", "<r><n>1</n><i>a</i><i>a</i></r>", f"<r {xsi}><n xsi:type='nowhere'>1</n></r>", "<r><n>2</n></r>")
    assert all(xsd.validate(schema, parse_xml(t)) == [] for t in good) and all(xsd.validate(schema, parse_xml(t)) for t in bad)
    with pytest.raises(xsd.SchemaError):
        xsd.compile(brace.parse("xs:schema(xmlns:xs = http://www.w3.org/2001/XMLSchema) { xs:element(name = r) { xs:simpleType { xs:restriction(base = xs:string) { xs:pattern(value = '[a') } } } }"))


def test_white_space_before_content_may_be_long(spark):
    texts = {"html": "<html></html>", "json": '{"a":1}', "xml": "<a/>", "brace": "a=b"}
    df = spark.createDataFrame([(k, " \n" * 600 + t) for k, t in texts.items()], "k string, t string")
    assert all(r.k == r.found for r in df.select("k", detect.content_type(df.t).alias("found")).collect())


@pytest.mark.parametrize(
    ("attributes", "want"),
    [
        ("level = multiple count = 's' format = '1.a'", "1;2;2.a;2.b;3;"),
        ("level = single count = 's' format = '01'", "01;02;01;02;03;"),
        ("level = any count = 's' format = 'I) '", "I) ;II) ;III) ;IV) ;V) ;"),
        ("level = any from = 't' count = 's'", "1;1;2;3;1;"),
        ("level = multiple count = 's | d' format = '(1-1-i)'", "(1-1);(1-2);(1-2-i);(1-2-ii);(1-3);"),
        ("value = 1234567 grouping-separator = ',' grouping-size = 3", "1,234,567;" * 5),
        ("value = '27' format = A", "AA;" * 5),
        ("value = 'position()' format = i", "i;ii;iii;iv;v;"),
    ],
)
def test_numbers_in_stylesheets(attributes, want):
    sheet = xslt.compile(brace.parse(f"xsl:stylesheet(version = 1.0 xmlns:xsl = http://www.w3.org/1999/XSL/Transform) {{ xsl:template(match = /) {{ xsl:for-each(select = '//s') {{ xsl:number({attributes}) ';' }} }} }}"))
    doc = parse_xml("<d><s/><t/><s><s/><s/></s><t/><s/></d>")
    assert markup.text(xslt.transform(sheet, doc)) == want


def test_space_is_stripped_from_the_elements_that_are_named():
    sheet = xslt.compile(brace.parse("xsl:stylesheet(version = 1.0 xmlns:xsl = http://www.w3.org/1999/XSL/Transform) { xsl:strip-space(elements = 'a b') xsl:preserve-space(elements = b) xsl:template(match = /) { xsl:copy-of(select = '/*') } }"))
    doc = parse_xml("<a> <b> </b> <c> </c></a>", trimmed=False)
    assert markup.xml(xslt.transform(sheet, doc), False) == "<a><b> </b><c> </c></a>"
