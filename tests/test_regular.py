"""Patterns of regular grammars give what the general parser gives."""

from __future__ import annotations

import random
import re

import pytest

from arbolith.grammar import registry, regular
from arbolith.plans import trees, xpath, xpath_tree
from arbolith.session import ship

LOG = "line = level, -': ', message. level = ['A'-'Z']+. message = ~[#a]*."
LISTS = "s = a, (-',', b)*, !'x', c?. a = ['a'-'c'; Nd]+. b = 'b' | 'bb', b. c = d. d = ['d' | #e9]."


def python(pattern: str) -> re.Pattern:
    """The pattern in Python's syntax, for grammars without categories."""
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern).replace("\\z", "\\Z").replace("\\p{Nd}", r"\d"))


@pytest.mark.parametrize(("grammar", "letters"), [(LOG, "AB: x\n"), (LISTS, "abdx,1é"), ("ixml:data/csv", 'a,"\n'), ("ixml:data/tsv", "a\tb\n"), ("ixml:data/url", "ab:/?#=&")])
def test_a_pattern_takes_what_the_grammar_takes(grammar, letters):
    r = random.Random(3)
    found = python(regular.pattern(grammar)[0])
    taken = 0
    for _ in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.randrange(9)))
        text = r.choice(["", "A: ", "ab", "a://b"]) + text
        root = registry.parse_text(grammar, text).children[0]
        fits = root.qname != "ixml"
        assert bool(found.match(text)) is fits, text
        taken += fits
    assert taken > 50


def test_what_is_not_regular_is_said():
    for grammar, fields in (("S = 'a', S, 'b' | 'c'.", ()), ("ixml:core/ixml", ()), ("ixml:data/csv", ("td",)), ("s = a. a = 'x', +'y'.", ("a",)), ("s =< 'a'.", ()), ("s = 'a'.", ("b",))):
        with pytest.raises(regular.NotRegular):
            regular.pattern(grammar, fields)


def test_fields_by_expressions_and_by_the_parser(spark):
    ship(spark)
    r = random.Random(4)
    texts = [None, "", *["".join(r.choice(["A", "B: ", ": ", "x", "é"]) for _ in range(r.randrange(6))) for _ in range(60)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    fast = regular.fields(df, "t", LOG, ("level", "message"))
    assert "MapInArrow" not in fast._jdf.queryExecution().executedPlan().toString()
    slow = regular.fields(df, "t", LOG.replace("level = ['A'-'Z']+", "level = 'A'*, l. -l = 'A' | ['B'-'Z'] | 'B', l, 'C'"), ("level", "message"))
    assert "MapInArrow" in slow._jdf.queryExecution().executedPlan().toString()
    paths = [xpath.parse(f"//{n}") for n in ("level", "message")]
    want = {x.doc_id: (x.level, x.message) for x in trees.parsed(df, "t", LOG).each(lambda doc: [tuple(None if doc.children[0].qname == "ixml" else xpath_tree.string(xpath_tree.evaluate(p, xpath_tree.Context(doc))) for p in paths)], "level string, message string").collect()}
    assert {x.doc_id: (x.level, x.message) for x in fast.collect()} == want and any(v[0] for v in want.values())
    own = {i: (m[1], m[2]) if (m := re.fullmatch(r"(A*(?:A|[B-Z]))(?:): ([^\n]*)", t)) else (None, None) for i, t in enumerate(texts) if t is not None}
    assert {x.doc_id: (x.level, x.message) for x in slow.collect()} == own
