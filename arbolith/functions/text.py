"""Scalar functions on texts, as expressions; nothing here leaves the JVM but what says so."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..sinks.brace_out import quote_compact as _quote_compact
from ..sinks.writers import quote_c  # noqa: F401
from .trimming import trim as _trim

NOT_QUOTED = "[Not a valid C escaped string]"


def unquote_c(text: Column) -> Column:
    """The content of a C string. Known escapes are decoded; of any other the backslash and its character vanish, also of a doubled backslash."""
    s = F.regexp_replace(text, "^[ \\t\\r\\n]*", "")
    body = F.regexp_extract(s, r'(?s)^"((?:[^"\\]|\\.)*)', 1)
    for name, char in (("n", "\n"), ("a", "\a"), ("b", "\b"), ("t", "\t"), ("v", "\v"), ("f", "\f"), ("r", "\r")):
        body = F.regexp_replace(body, rf"(?s)(?<!\\)((?:\\\\)*)\\{name}", f"$1{char}")
    body = F.regexp_replace(body, r'(?s)\\(?:(")|.)', "$1")
    return F.when(s.startswith('"'), body).otherwise(NOT_QUOTED)


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def char_length(text: Column) -> Column:
    return F.char_length(text).cast("long")


def quotes_needed(text: Column, quote: str = "'") -> Column:
    """Quote characters that a text needs around it: one more than the longest run in it, but never two."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"({quote}+)")), F.length)), F.lit(0))
    return F.when(longest == 1, 3).otherwise(longest + 1)


def line_of(text: Column, offset: Column) -> Column:
    """Line of an offset from 0, counted from 1."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """Column of an offset from 0, counted from 1."""
    return F.char_length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1


def is_json_number(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"))


def is_json_keyword(text: Column) -> Column:
    return text.isin("true", "false", "null")


def is_name(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"^[A-Za-z_][A-Za-z0-9_.:#-]*$"))


def in_category(char: Column, category: str) -> Column:
    """Whether a character is of a Unicode category such as Lu or N."""
    return F.regexp_like(char, F.lit(rf"^\p{{{category}}}$"))


def safe_name(text: Column) -> Column:
    """A shell-safe name: everything but letters, digits and underscores becomes an underscore."""
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def escape_comment(text: Column) -> Column:
    """With a mark between adjacent hyphens, which XML comments may not hold."""
    return F.regexp_replace(F.regexp_replace(text, "-(?=-)", "-␐"), "-$", "-␐")


def unescape_comment(text: Column) -> Column:
    return F.regexp_replace(text, "-␐", "-")


def parse_number(text: Column) -> Column:
    """An integer in C notation: 0x hexadecimal, 0 octal, else decimal."""
    from ..operators.measure import c_integer

    return c_integer(text)


def entity_char(name: Column) -> Column:
    """The character of an entity: apos gt lt quot amp nbsp, #n or #xh; null for others."""
    known = F.create_map(*[F.lit(x) for p in (("apos", "'"), ("gt", ">"), ("lt", "<"), ("quot", '"'), ("amp", "&"), ("nbsp", "\xa0")) for x in p])
    code = F.when(name.startswith("#x"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8)).try_cast("int")
    return F.coalesce(F.try_element_at(known, name), F.when(code.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))


@pandas_udf(StringType())
def quote_compact(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The shortest form of a value on one line of brace syntax (Arrow batches)."""
    for s in parts:
        yield s.map(_quote_compact, na_action="ignore")


@pandas_udf(StringType())
def trim_quote(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A text without incidental indentation (Arrow batches)."""
    for s in parts:
        yield s.map(_trim, na_action="ignore")
