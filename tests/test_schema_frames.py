"""Schemas as columns agree with the one-pass validator on which documents are right."""

from __future__ import annotations

import random

import pytest

from arbolith.plans import schema_frames, xsd
from arbolith.session import ship
from arbolith.sources import brace, readers
from arbolith.sources.markup import parse_xml

SCHEMA = """xs:schema(xmlns:xs = http://www.w3.org/2001/XMLSchema) {
    xs:element(name = r) { xs:complexType {
        xs:sequence {
            xs:element(name = n type = N maxOccurs = 3)
            xs:element(name = w minOccurs = 0 maxOccurs = unbounded) { xs:simpleType { xs:restriction(base = xs:string) { xs:pattern(value = '[a-z-[aeiou]]+') xs:maxLength(value = 3) } } }
            xs:element(name = p minOccurs = 0) { xs:complexType { xs:all { xs:element(name = a type = xs:date minOccurs = 0) xs:element(name = b type = L minOccurs = 0) } xs:attribute(name = k type = E) } }
        }
        xs:attribute(name = id type = xs:positiveInteger use = required)
    } }
    xs:simpleType(name = N) { xs:restriction(base = xs:decimal) { xs:minInclusive(value = -1) xs:maxExclusive(value = 10.5) xs:fractionDigits(value = 1) } }
    xs:simpleType(name = L) { xs:restriction { xs:simpleType { xs:list(itemType = xs:int) } xs:length(value = 2) } }
    xs:simpleType(name = E) { xs:restriction(base = xs:int) { xs:enumeration(value = 1) xs:enumeration(value = 20) } }
}"""


def document(r: random.Random) -> str:
    n = "".join(f"<n>{r.choice(['1', '-1', '10.4', '10.5', ' 2 ', 'x', '3.25', '']) if r.random() < 0.3 else '7.5'}</n>" for _ in range(r.choice([1, 2, 3, 3, 4, 0])))
    w = "".join(f"<w>{r.choice(['bcd', 'b', 'bad', 'bcdf']) if r.random() < 0.3 else 'xyz'}</w>" for _ in range(r.randrange(3)))
    b = f"<b>{r.choice(['1 2', '1', '1 x', ' 3  4 '])}</b>" if r.random() < 0.4 else ""
    a = f"<a>{r.choice(['2024-01-31', 'never', '2024-13-01'])}</a>" if r.random() < 0.3 else ""
    p = f"<p{r.choice(['', '', ' k=\"01\"', ' k=\"2\"', ' z=\"1\"'])}>{r.choice([a + b, b + a])}</p>" if r.random() < 0.6 else ""
    parts = [n, w, p] if r.random() < 0.9 else [p, w, n]
    extra = r.choice(["", "", "", "", "", "<x/>"])
    return f"<r{r.choice([' id=\"4\"'] * 6 + ['', ' id=\"0\"', ' id=\"4\" no=\"1\"'])}>{''.join(parts)}{extra}</r>"


def test_documents_are_right_for_both(spark):
    ship(spark)
    r = random.Random(6)
    texts = [document(r) for _ in range(400)] + ["<s/>", "<r", "<r id='1'><n>1</n></r>"]
    schema = xsd.compile(brace.parse(SCHEMA))
    nodes = readers.nodes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string"), "t", kind="xml")
    wrong = {x.doc_id for x in schema_frames.violations(nodes, schema, "r").collect()}

    def bad(text: str) -> bool:
        try:
            return bool(xsd.validate(schema, parse_xml(text)))
        except ValueError:
            return True

    want = {i for i, t in enumerate(texts) if bad(t)}
    assert wrong == want, [texts[i] for i in wrong ^ want][:3]
    assert 50 < len(want) < 390


def test_keys_in_documents_and_across(spark):
    ship(spark)
    texts = [(1, "<s><k a='1' b='x'/><k a='1' b='y'/><k a='1' b='x'/><f r='1' q='x'/><f r='2' q='x'/><k a='9'/></s>"), (2, "<s><k a='2' b='x'/><f r='1' q='x'/></s>")]
    nodes = readers.nodes(spark.createDataFrame(texts, "doc_id long, t string"), "t", kind="xml")
    keys, refs = schema_frames.keys(nodes, "//k", ["@a", "@b"]), schema_frames.keys(nodes, "//f", ["@r", "@q"])
    assert [tuple(x) for x in schema_frames.duplicates(keys).collect()] == [(1, "1", "x", 2)]
    assert sorted((x.doc_id, x.k0) for x in schema_frames.broken(refs, keys).collect()) == [(1, "2"), (2, "1")]
    assert schema_frames.broken(refs, keys, across=True).collect() == []


@pytest.mark.parametrize("content", ["xs:choice { xs:element(name = a type = xs:int) }", "xs:sequence { xs:element(ref = r) }", "xs:sequence { xs:element(name = a type = xs:int) xs:element(name = b type = xs:int) xs:element(name = a type = xs:int) }"])
def test_other_schemas_are_refused(spark, content):
    schema = xsd.compile(brace.parse("xs:schema(xmlns:xs = http://www.w3.org/2001/XMLSchema) { xs:element(name = r type = T) xs:complexType(name = T) { " + content + " } }"))
    with pytest.raises(schema_frames.NotRelational):
        schema_frames.violations(spark.range(0), schema, "r")
