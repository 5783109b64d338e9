"""Content types from the first characters of a text, as an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("brace", "xml", "html", "json", "text", "ixml", "clines")
_WS = r"[ \t\r\n]*"


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\\x{FEFF}", "")


def content_type(text: Column) -> Column:
    """xml, html, json or brace; null stays null. Comments before the first tag are skipped; an open one means xml."""
    s = F.regexp_replace(without_bom(text), f"(?s)^({_WS}<!--.*?-->)+", "")
    start = F.lower(F.substring(F.ltrim(s, F.lit(" \t\r\n")), 1, 512))  # what stands first, however much white space is before it
    return (
        F.when(text.isNull(), F.lit(None))
        .when(F.regexp_like(without_bom(text), F.lit(rf"^{_WS}<\?xml")), "xml")
        .when(start.startswith("<!--"), "xml")
        .when(F.regexp_like(start, F.lit(r"^<[ \t\r\n]*html([^a-z0-9_-]|$)")), "html")
        .when(F.regexp_like(start, F.lit(r"^<!doctype[ \t\r\n]+html")), "html")
        .when(start.startswith("<"), "xml")
        .when(F.regexp_like(start, F.lit(r'^[{"\[0-9]')), "json")
        .when(F.regexp_like(s, F.lit(rf"^{_WS}(true|false|null)\n?$")), "json")
        .otherwise("brace")
    )


def unfit(text: Column, kind: str) -> Column:
    """A message if a text can't be taken as ``kind``: text, ixml and clines take anything, html takes xml too."""
    found = content_type(text)
    if kind in ("text", "ixml", "clines"):
        return F.lit(None).cast("string")
    fine = found.isin("html", "xml") if kind == "html" else found == kind
    return F.when(~fine, F.concat(F.lit(f"expected {kind}, found "), found))
