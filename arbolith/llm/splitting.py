"""Splits text by a tokenizer's pattern, faster where a text has Latin-1 characters only."""

from __future__ import annotations

import re

import regex


def _latin(pattern: str) -> str | None:
    """The same pattern for texts of Latin-1 characters, with Unicode classes spelt out for Python's ``re``; None if it has other parts."""
    rest = re.sub(r"\\p\{[LN]\}|\\[sS]", "", pattern)
    if "\\" in rest:
        return None
    members = {k: "".join(re.escape(chr(c)) for c in range(256) if regex.fullmatch(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s", r"\S")}
    out, inside, at = [], False, 0
    while at < len(pattern):
        if m := re.match(r"\\p\{[LN]\}|\\[sS]", pattern[at:]):
            out.append(members[m[0]] if inside else f"[{members[m[0]]}]")
            at += len(m[0])
            continue
        inside = (inside or pattern[at] == "[") and pattern[at] != "]"
        out.append(pattern[at])
        at += 1
    return "".join(out)


class Splitter:
    """findall and finditer of a pattern of the ``regex`` module."""

    def __init__(self, pattern: str):
        self.any = regex.compile(pattern)
        latin = _latin(pattern)
        self.latin = re.compile(latin) if latin is not None else self.any

    def _for(self, text: str):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any
        return self.latin

    def __call__(self, text: str) -> list[str]:
        return self._for(text).findall(text)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self._for(text).finditer(text)]
