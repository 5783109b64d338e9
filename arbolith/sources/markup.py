"""XML by expat and tag-soup HTML, as trees."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat

from ..functions.trimming import trim
from ..model import Node, document, qualify, shred
from ..sinks.markup import HYPHEN_MARK, RAW, VOID
from .brace import ParseError

#: Fixed values of the HTML standard: what an opening tag closes if it is open, up to the nearest of the scopes.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "head": (), "body": ("head",),
}
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
HEAD_ONLY = frozenset(("title", "meta", "link", "base", "script", "style"))


_DECLARATION = re.compile(r"<!--.*?-->|<\?.*?\?>|<!(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|%[^;\s]+;", re.DOTALL)


def _spaced(declaration: str) -> str:
    """A declaration with one space for each run of white space outside quotes."""
    if declaration[:4] == "<!--":
        return declaration
    return "".join(x if x[0] in "\"'" else re.sub(r"\s+", " ", x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^\"']+|[\"']", declaration))


def fix_comment(text: str) -> str:
    """Takes the marks between hyphens out of a comment."""
    while f"-{HYPHEN_MARK}-" in text:
        text = text.replace(f"-{HYPHEN_MARK}-", "--")
    return text[:-1] if text.endswith("-" + HYPHEN_MARK) else text


def trim_children(n: Node, alone: bool = True) -> None:
    """Trims the texts and comments right below a node; ``alone``: whether it has no other children."""
    kept = []
    for c in n.children:
        if c.kind == "comment":
            c.value = trim(c.value or "", brace=False).strip(" \n")
        elif c.kind == "text":
            if not (c.value or "").strip(" \t\r\n"):
                continue
            c.value = trim(c.value, brace=False)
            if "\n" not in c.value and alone and len(n.children) == 1:
                c.value = c.value.strip(" \t\r\n")
        kept.append(c)
    n.children = kept


def trim_tree(doc: Node) -> None:
    """Drops text of white space alone and takes incidental indentation off the rest; text of script and style stays."""
    for n in list(doc.walk()):
        trim_children(n)


def expat_for(at: list[Node], opened: list[Node] | None = None) -> expat.XMLParserType:
    """A parser that builds nodes below the last of ``at``, which holds the open ones, a document first; elements are added to ``opened``."""
    doc = at[0]
    p = expat.ParserCreate()
    p.buffer_text = True
    p.ordered_attributes = True
    p.UseForeignDTD(True)
    p.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)

    def start(name: str, attrs: list[str]) -> None:
        prefix, _, local = name.rpartition(":")
        node = at[-1].add(Node("element", local, prefix or None))
        for k, v in zip(attrs[::2], attrs[1::2], strict=True):
            if k == "xmlns" or k.startswith("xmlns:"):
                node.add(Node("namespace", k[6:], value=v))
            else:
                a, _, b = k.rpartition(":")
                node.add(Node("attribute", b, a or None, v))
        at.append(node)
        if opened is not None:
            opened.append(node)

    def end(name: str) -> None:
        at.pop()

    def data(value: str) -> None:
        here = at[-1]
        if here.kind == "document":
            return
        if here.children and here.children[-1].kind == "text":
            here.children[-1].value += value
        else:
            here.add(Node("text", value=value))

    def skipped(name: str, parameter: bool) -> None:
        if not parameter:
            at[-1].add(Node("entity", name))

    subset: list[str] | None = None  # what stands in a document type's brackets, while it is being read

    def default(value: str) -> None:
        if subset is not None:
            subset.append(value)
        elif re.fullmatch(r"&[^;#]+;", value):
            at[-1].add(Node("entity", value[1:-1]))

    def start_type(name: str, system: str | None, public: str | None, inner: int) -> None:
        nonlocal subset
        subset = []
        doc.add(Node("doctype", "DOCTYPE", value=name + (f' PUBLIC "{public}"' if public else " SYSTEM" if system else "") + (f' "{system}"' if system else "")))

    def end_type() -> None:
        nonlocal subset
        if found := [_spaced(x) for x in _DECLARATION.findall("".join(subset or []))]:
            doc.children[-1].value += " [\n" + "\n".join(found) + "\n]"
        subset = None

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, data
    p.CommentHandler = lambda v: at[-1].add(Node("comment", value=fix_comment(v))) if subset is None else subset.append(f"<!--{v}-->")
    p.ProcessingInstructionHandler = lambda n, v: at[-1].add(Node("pi", n, value=v)) if subset is None else subset.append(f"<?{n} {v}?>")
    p.StartDoctypeDeclHandler, p.EndDoctypeDeclHandler = start_type, end_type
    p.SkippedEntityHandler = skipped
    p.DefaultHandler = default  # which also keeps declared entities from being put in place of their references
    return p


def _whole(source: str) -> str:
    return source.removeprefix("\ufeff").lstrip() if source[:1] in "\ufeff \t\r\n" else source


def _read(p: expat.XMLParserType, source: str) -> None:
    try:
        p.Parse(_whole(source), True)
    except expat.ExpatError as e:
        lines = source.split("\n")
        offset = sum(len(x) + 1 for x in lines[: e.lineno - 1]) + e.offset
        raise ParseError(expat.ErrorString(e.code), source, offset) from None


def parse_xml(source: str, trimmed: bool = True) -> Node:
    """Well-formed XML; CDATA becomes text, references to entities stay nodes, but in attributes those that are declared are replaced. Nothing is fetched."""
    doc = document()
    _read(expat_for([doc]), source)
    if trimmed:
        trim_tree(doc)
    qualify(doc)
    return doc


def check_xml(source: str) -> None:
    """A ParseError if ``parse_xml`` would give one."""
    p = expat_for([document()])
    for event in ("StartElement", "EndElement", "CharacterData", "Comment", "ProcessingInstruction", "StartDoctypeDecl", "EndDoctypeDecl", "SkippedEntity"):
        setattr(p, f"{event}Handler", None)
    p.DefaultHandler = lambda x: None  # there, as it keeps entities from being put in place
    _read(p, source)


#: What a text has to be without for ``plain_rows``: all that isn't elements, attributes and texts of one line.
_NOT_PLAIN = re.compile(r"<[!?]|[&\n\r\t]|xmlns")


def plain_rows(source: str, doc_id: int | None, trimmed: bool = True) -> list[tuple] | None:
    """The rows of ``parse_xml``'s tree, made while a text of elements, attributes and texts of one line is read; None for other texts and those that are wrong.

    By way of a tree a node takes some six times as long.
    """
    if source[:1] != "<" or _NOT_PLAIN.search(source):
        return None
    rows: list[tuple | None] = []
    at: list[list] = []  # of the open elements: number, path, name, next place, children read, place
    held: list[str] = []  # a text that isn't a row yet, as it may be alone in its element
    post, here, level = 0, [-1, "", None, 0, 0, 0], 0

    def text(alone: bool) -> None:
        nonlocal post
        value = "".join(held)
        held.clear()
        here[4] += 1
        if trimmed:
            bare = value.strip(" ")
            if not bare:
                return
            value = bare if alone else value
        rows.append((doc_id, len(rows), post, here[0], level, here[3], "text", None, None, None, value, here[1]))
        here[3] += 1
        post += 1

    def start(name: str, attrs: list[str]) -> None:
        nonlocal post, here, level
        if held:
            text(False)
        pre, path = len(rows), f"{here[1]}/{name}"
        mine = [pre, path, name, len(attrs) // 2, 0, here[3]]
        here[3] += 1
        here[4] += 1
        rows.append(None)
        level += 1
        for i in range(0, len(attrs), 2):
            rows.append((doc_id, len(rows), post, pre, level, i // 2, "attribute", None, attrs[i], None, attrs[i + 1], f"{path}/@{attrs[i]}"))
            post += 1
        at.append(here)
        here = mine

    def end(name: str) -> None:
        nonlocal post, here, level
        if held:
            text(not here[4])
        pre, path, _, _, _, place = here
        here = at.pop()
        level -= 1
        rows[pre] = (doc_id, pre, post, here[0], level, place, "element", None, name, None, None, path)
        post += 1

    p = expat.ParserCreate()
    p.buffer_text = p.ordered_attributes = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, held.append
    try:
        p.Parse(source, True)
    except (expat.ExpatError, UnicodeError):
        return None
    return None if any(r[8] and ":" in r[8] for r in rows) else rows  # type: ignore[index]


#: Elements that end before what is complete goes out as rows.
_ENDS = 2_000


def xml_rows(source: str, doc_id: int | None, trimmed: bool = True, ends: int = _ENDS) -> Iterator[list[tuple]]:
    """The rows of ``parse_xml``'s tree in pieces and in no order, without the tree: what is complete leaves memory after so many ends of elements.

    A text that is wrong is an error before any rows come, so it is read twice, the first time for errors alone.
    """
    check_xml(source)
    source = _whole(source)
    doc = document()
    at, rows = [doc], []
    # of each open node that rows have gone out for: number, children gone (before trimming, after it), names in scope, path, row
    gone: dict[int, list] = {id(doc): [-1, 0, 0, {}, "", None]}
    pre = post = ended = 0

    def add(nodes: list[Node], parent: int, level: int, place: int, base: str, scope: dict[str, str]) -> None:
        nonlocal pre, post
        holder = document()
        holder.children = nodes
        qualify(holder, scope)
        made = shred(holder, doc_id)
        rows.extend((d, a + pre, b + post, c + pre if c >= 0 else parent, lev + level, o + place if c < 0 else o, *rest, base + path) for d, a, b, c, lev, o, *rest, path in made)
        pre, post = pre + len(made), post + len(made)

    def out(closing: bool) -> None:
        """All that is complete; ``closing``: the last of ``at`` ends."""
        nonlocal pre, post
        for level, n in enumerate(at):
            if id(n) not in gone:
                above = gone[id(at[level - 1])]
                alone = Node("element", n.name, n.prefix)
                alone.attrs = n.attrs
                first, since = pre, len(rows)
                add([alone], above[0], level - 1, above[2], above[4], above[3])
                own = rows.pop(since)
                post -= 1  # the element's own end is still to come
                spaces = {a.name or "": a.value or "" for a in n.attrs if a.kind == "namespace"}
                gone[id(n)] = [first, 0, len(n.attrs), above[3] | spaces if spaces else above[3], own[-1], own]
            mine, last = gone[id(n)], level == len(at) - 1
            kept = [] if last else n.children[-1:]  # the next of ``at``
            raw = len(n.children) - len(kept)
            n.children = n.children[:raw]
            if trimmed:
                for c in n.children:
                    trim_tree(c)
                trim_children(n, closing and last and not mine[1])
            done, n.children = n.children, kept
            mine[1] += raw
            if done:
                add(done, mine[0], level, mine[2], mine[4], mine[3])
                mine[2] += len(done)

    p = expat_for(at)

    def end(name: str) -> None:
        nonlocal ended, post
        if id(at[-1]) in gone:
            out(True)
            n = at.pop()
            d, a, _, *rest = gone.pop(id(n))[-1]
            rows.append((d, a, post, *rest))
            post += 1
            at[-1].children.pop()
            gone[id(at[-1])][1] += 1
            gone[id(at[-1])][2] += 1
            return
        at.pop()
        ended += 1
        if ended >= ends:
            ended = 0
            out(False)

    p.EndElementHandler = end
    for i in range(0, len(source), 1 << 16):
        p.Parse(source[i : i + (1 << 16)], False)
        if rows:
            yield rows[:]
            rows.clear()
    p.Parse("", True)
    out(True)
    yield rows


class _Soup(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.doc = document()
        self.open: list[Node] = []
        self.at = 0  # where in rawdata the parser stands

    def updatepos(self, i: int, j: int) -> int:
        self.at = j
        return super().updatepos(i, j)

    def here(self) -> Node:
        return self.open[-1] if self.open else self.doc

    def named(self, name: str) -> Node | None:
        return next((n for n in self.open if n.name == name), None)

    def push(self, name: str, attrs: list = ()) -> Node:  # type: ignore[assignment]
        prefix, _, local = name.rpartition(":")
        node = self.here().add(Node("element", local, prefix or None))
        for k, v in attrs:
            if k and not node.attr(k):
                node.add(Node("attribute", k, value=v))
        if name not in VOID:
            self.open.append(node)
        return node

    def frame(self, content: str | None) -> None:
        """Opens html, head or body if what comes needs them."""
        if not self.named("html"):
            root = next((c for c in self.doc.children if c.kind == "element"), None)
            self.open = [root] if root else []
            if not root:
                self.push("html")
        if content in ("head", "body", "frameset"):
            return
        if self.named("body") or self.named("head") and content in HEAD_ONLY:
            return
        if content in HEAD_ONLY and not any(c.name == "body" for c in self.open[0].children):
            self.push("head")
            return
        del self.open[1:]
        body = next((c for c in self.open[0].children if c.name == "body"), None)
        self.open.append(body) if body else self.push("body")

    def close_for(self, tag: str) -> None:
        closing = CLOSES.get(tag, ())
        if tag in BLOCKS:
            closing = (*closing, "p")
        stops = SCOPES.get(tag, ())
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].name in stops or (self.open[i].name in BLOCKS and self.open[i].name not in closing and tag not in ("li", "dt", "dd")):
                break
            if self.open[i].name in closing:
                del self.open[i:]
                if tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "body"):
                    continue
                break

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            if root := next((c for c in self.doc.children if c.kind == "element"), None):
                for k, v in attrs:
                    if not root.attr(k):
                        root.add(Node("attribute", k, value=v))
            else:
                self.push(tag, attrs)
            return
        self.close_for(tag)
        self.frame(tag)
        if tag in ("head", "body") and self.named(tag):
            return
        self.push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].qname == tag:
                del self.open[i:]
                return
        if tag == "p":
            self.frame("p")
            self.push("p")
            self.open.pop()

    def _text(self, value: str) -> None:
        here = self.here()
        if here.kind == "document" or here.name in ("html", "head"):
            if not value.strip(" \t\r\n"):
                if here.name == "html":
                    here.add(Node("text", value=value))
                return
            self.frame(None)
            here = self.here()
        if here.children and here.children[-1].kind == "text":
            here.children[-1].value += value
        else:
            here.add(Node("text", value=value))

    def handle_data(self, data: str) -> None:
        here = self.here()
        if here.name in RAW:
            here.add(Node("cdata", value=data)) if not here.children else setattr(here.children[-1], "value", here.children[-1].value + data)
        else:
            self._text(data)

    def handle_entityref(self, name: str) -> None:
        from html.entities import html5

        closed = self.rawdata.startswith(";", self.at + 1 + len(name))
        if closed and (c := html5.get(name + ";")):
            self._text(c)
        else:
            self._text(f"&{name}{';' if closed else ''}")

    def handle_charref(self, name: str) -> None:
        from html import unescape

        self._text(unescape(f"&#{name};"))

    def handle_comment(self, data: str) -> None:
        self.here().add(Node("comment", value=fix_comment(data)))

    def handle_decl(self, decl: str) -> None:
        if decl[:7].lower() == "doctype":
            self.doc.add(Node("doctype", "DOCTYPE", value=decl[7:].strip()))

    def handle_pi(self, data: str) -> None:
        name, _, value = data.rstrip("?").partition(" ")
        self.here().add(Node("pi", name, value=value))


def parse_html(source: str, trimmed: bool = True) -> Node:
    """Tag soup: html, head and body are supplied, li, p, table parts and options close by themselves, stray end tags go.

    Script and style have one CDATA node. References to characters become text, those by name only with their semicolon. An empty document is an error.
    """
    soup = _Soup()
    soup.feed(source.removeprefix("﻿"))
    soup.close()
    if not any(c.kind == "element" for c in soup.doc.children):
        raise ParseError("the html document is empty", source, 0)
    if trimmed:
        trim_tree(soup.doc)
    qualify(soup.doc)
    return soup.doc
