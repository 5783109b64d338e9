"""Incidental indentation of quotes, comments and marked-up text."""

from __future__ import annotations

SPACES = " \t\r\n"


def incidental(lines: list[str]) -> int:
    """The least number of leading spaces of lines after the first that have content; 0 if there are none."""
    return min((len(x) - len(x.lstrip(" ")) for x in lines[1:] if x.strip(SPACES)), default=0)


def trim(text: str, brace: bool = True, comment: bool = False) -> str:
    """Strips a last blank line, a first blank line and the indentation that the other lines share.

    Of k newlines in white space at the end, k - 1 stay. In brace syntax (``brace``) a closing quote that stands further left
    than the text sets the indentation.
    """
    tail = text[len(text.rstrip(SPACES)) :]
    more, last = "", None
    if "\n" in tail:
        more = "\n" * (tail.count("\n") - 1)
        last = len(tail) - tail.rindex("\n") - 1
        text = text[: len(text) - len(tail)]
    if not text:
        return more
    if "\n" not in text:
        return text + more
    lines = text.split("\n")
    first = bool(lines[0].strip(SPACES))
    cut = incidental(lines)
    if brace and last is not None and last < cut:
        cut = last + first + 2 * (first and comment)
    if not first:
        lines = lines[1:]
    out = []
    for i, line in enumerate(lines):
        if i or not first:
            line = line[min(cut, len(line) - len(line.lstrip(" "))) :]
        out.append(line.rstrip(" \t\r") if i < len(lines) - 1 else line)
    return "\n".join(out) + more
