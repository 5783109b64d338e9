"""Grammars that are regular, as patterns for the JVM: records parsed by expressions, with no Python stage.

A rule is regular here if it refers to itself, if at all, only at the front or only at the end of its alternatives, as repetitions do. Its graph then folds into one pattern from
the leaves up. All other grammars go to the general parser, with equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import trees, xpath, xpath_tree
from . import registry
from .front import Grammar, Rule, Set, Term, parse


class NotRegular(ValueError):
    """A grammar, or a part that is asked for, that has no pattern."""


def _quoted(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" if not c.isalnum() or not c.isascii() else c for c in text)


def _set(s: Set) -> str:
    members = "".join(_quoted(a) if a == b else f"{_quoted(a)}-{_quoted(b)}" for a, b in s.ranges)
    members += "".join(r"\p{Lu}\p{Ll}\p{Lt}" if c == "LC" else f"\\p{{{c}}}" for c in s.categories)
    if not members:
        return "(?s:.)" if s.negated else "(?!)"
    return f"[{'^' if s.negated else ''}{members}]"


class _Folder:
    """Patterns of rules; those of ``fields`` are groups, of which each may stand in one place only and not in a repetition."""

    def __init__(self, grammar: Grammar, fields: tuple[str, ...]):
        self.grammar, self.fields = grammar, fields
        self.groups: list[str] = []
        self.open: list[str] = []
        self.loops = 0  # repetitions that the walk is inside of
        self.inside: str | None = None  # field that the walk is inside of

    def term(self, t: Term) -> str:
        if self.inside is not None and (t.kind == "insert" or t.kind in ("text", "set") and t.mark == "-"):
            raise NotRegular(f"the text of {self.inside} isn't what stands there")
        if t.kind == "text":
            return _quoted(str(t.value))
        if t.kind == "set":
            return _set(t.value)
        if t.kind == "insert":
            return ""
        if t.kind == "not":
            return f"(?!{_set(t.value) if isinstance(t.value, Set) else _quoted(str(t.value))})"
        return self.rule(str(t.value), t)

    def sequence(self, terms: tuple[Term, ...]) -> str:
        return "".join(self.term(t) for t in terms)

    def rule(self, name: str, term: Term | None = None) -> str:
        rule = self.grammar.rules[name]
        shown = (term.alias if term else None) or rule.alias or name
        mark = (term.mark if term else "") or rule.mark
        if rule.cost:
            raise NotRegular("costs choose between parses")
        if name in self.open:
            raise NotRegular(f"{name} refers to itself in the middle")
        if shown in self.fields and mark != "-" and not rule.helper:
            if self.loops or shown in self.groups or self.inside is not None:
                raise NotRegular(f"{shown} can stand in several places")
            self.groups.append(shown)
            self.inside = shown
            out = f"({self.folded(rule)})"
            self.inside = None
            return out
        return f"(?:{self.folded(rule)})"

    def folded(self, rule: Rule) -> str:
        """x | self y becomes x y*, and x | y self becomes y* x."""
        mine = [a for a in rule.alternatives if any(t.kind == "rule" and t.value == rule.name for t in a)]
        rest = sorted((a for a in rule.alternatives if a not in mine), key=lambda a: not a)  # nothing comes last, so as much as can be is taken
        self.open.append(rule.name)
        if mine:
            front = all(a[0].kind == "rule" and a[0].value == rule.name for a in mine)
            back = all(a[-1].kind == "rule" and a[-1].value == rule.name for a in mine)
            if not (front or back) or any(sum(t.kind == "rule" and t.value == rule.name for t in a) > 1 for a in mine):
                raise NotRegular(f"{rule.name} refers to itself in the middle")
            self.loops += 1
            base = "|".join(self.sequence(a) for a in rest)
            more = "|".join(self.sequence(a[1:] if front else a[:-1]) for a in mine)
            self.loops -= 1
            loop = f"{more}*" if re.fullmatch(r"\[(?:[^\]\\]|\\.)*\]", more) else f"(?:{more})*"
            out = f"(?:{base}){loop}" if front else f"{loop}(?:{base})"
        else:
            out = "|".join(self.sequence(a) for a in rest)
        self.open.pop()
        return out


def pattern(grammar: str, fields: tuple[str, ...] = (), start: str | None = None) -> tuple[str, list[str]]:
    """A pattern for whole texts, and the names of its groups in order. ``grammar``: a text or ixml:NAME; ``start``: a rule to start from. NotRegular if there is none."""
    g = parse(registry.GRAMMARS[grammar[5:]] if grammar.startswith("ixml:") else grammar)
    folder = _Folder(g, fields)
    found = folder.rule(start or g.start)
    if missing := set(fields) - set(folder.groups):
        raise NotRegular(f"no {', '.join(sorted(missing))}")
    return f"\\A{found}\\z", folder.groups


def fields(df: DataFrame, content: Column | str, grammar: str, names: tuple[str, ...], doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and a column for each name: the text of that element in the document that a grammar makes of a text; empty where it has none, null where the text doesn't parse.

    With a regular grammar these are expressions. Where the elements aren't plain parts of the text, or the grammar isn't regular, texts go through the general parser.
    """
    content = F.col(content) if isinstance(content, str) else content
    try:
        whole, groups = pattern(grammar, names)
    except NotRegular:
        paths = [xpath.parse(f"//{n} | //@{n}") for n in names]

        def row(doc) -> list[tuple]:
            top = doc.children[0] if doc.children else None
            if top is None or any(a.kind == "attribute" and a.value == "failed" for a in top.attrs):
                return [tuple(None for _ in names)]
            return [tuple(xpath_tree.string(xpath_tree.evaluate(p, xpath_tree.Context(doc))) for p in paths)]

        slim = df.select(F.col(doc_id).alias("doc_id"), content.alias("raw"))
        return trees.parsed(slim, "raw", grammar, "doc_id").each(row, ", ".join(f"{n} string" for n in names)).withColumnRenamed("doc_id", doc_id)
    fits = F.regexp_like(content, F.lit(whole))
    return df.filter(content.isNotNull()).select(F.col(doc_id), *[F.when(fits, F.regexp_extract(content, whole, groups.index(n) + 1)).alias(n) for n in names])
