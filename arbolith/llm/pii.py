"""Personal data: regular expressions propose spans, checksums confirm them, words around them move their score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

#: Kinds in the order in which spans are listed; the first four are the base, which stays whatever its score.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE = KINDS[:4]
#: Score of a span before its surroundings are looked at, what a word nearby adds or takes, and what an added kind needs.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "local_phone": 0.3}
NEARBY, GAIN, LOSS, NEEDED = 48, 0.3, 0.3, 0.6
CONTEXT = {
    "email": r"e-?mail|mail|contact|write",
    "ip": r"ip|address|host|server|login",
    "card": r"card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|cell|whatsapp|telefon|téléphone|teléfono",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "ssn": r"ssn|social security|sozialversicherung|sécurité sociale|seguridad social",
    "local_phone": r"phone|tel|call|mobile|fax|cell|whatsapp|telefon|téléphone|teléfono",
}
AGAINST = {
    "email": r"example",
    "ip": r"version|release|section|chapter",
    "card": r"order|tracking|invoice|serial|isbn",
    "phone": r"order|tracking|invoice|serial|isbn|version",
    "iban": r"serial|version",
    "ssn": r"order|part|serial|model|version",
    "local_phone": r"order|part|serial|model|version|isbn",
}
_FOR = {k: re.compile(rf"\b(?:{w})\b", re.I) for k, w in CONTEXT.items()}
_NOT = {k: re.compile(rf"\b(?:{w})\b", re.I) for k, w in AGAINST.items()}

# Characters of an international bank account number by country, of the public registry.
_IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BI=27, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DJ=27, DK=18, DO=28,
    EE=20, EG=29, ES=24, FI=18, FK=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27,
    JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MN=20, MR=27, MT=31, MU=30, NI=28, NL=18,
    NO=15, OM=23, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, RU=33, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, SO=23, ST=25, SV=28,
    TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20, YE=30,
)
_IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(_IBAN_LENGTHS.values())}

# The patterns' repeats never give back what they took, where that can't change a match: all run in linear time.
_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")


@dataclass(frozen=True, slots=True)
class Span:
    """Code points ``start`` to ``end``, exclusive."""

    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign outwards; the same spans as of the pattern read from the left."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL_PART.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1  # no local part goes across an at sign
            at = text.find("@", at + 1)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Numbers of their country's length with the right check digits; what follows, such as a bank's code, plays no part."""
    last = 0
    for m in _IBAN.finditer(text):
        n = _IBAN_LENGTHS.get(m[0][:2])
        if n and m.start() >= last and (rest := _IBAN_REST[n].match(text, m.end())) and mod97((m[0] + rest[0]).replace(" ", "")):
            last = rest.end()
            yield m.start(), last


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans by kind, then start."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for a, b in _ibans(text):
        yield "iban", a, b
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()
    for m in _LOCAL.finditer(text):
        yield "local_phone", *m.span()


def find(text: str) -> list[Span]:
    """Spans by kind as listed in KINDS, then by start.

    Base spans are all kept. One of another kind needs a score of NEEDED and may not overlap a base span.
    """
    out: list[Span] = []
    base: list[tuple[int, int]] = []
    for kind, a, b in _proposed(text):
        around = text[max(0, a - NEARBY) : a] + " " + text[b : b + NEARBY]
        score = PRIOR[kind] + GAIN * bool(_FOR[kind].search(around)) - LOSS * bool(_NOT[kind].search(around))
        score = round(min(1.0, max(0.0, score)), 3)
        if kind in BASE:
            base.append((a, b))
        elif score < NEEDED or any(a < y and x < b for x, y in base):
            continue
        out.append(Span(kind, a, b, score))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with a mark such as [EMAIL] in place of each span, or of spans that overlap, by the first one's kind."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def detect(df: DataFrame, text: str = "text", out: str = "pii_spans", redact: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and ``out``: the spans of each whole text; with ``redact``, that column has the text without them.

    Columns of those names are replaced. A null text has no spans and stays null. No shuffle; repeated rows are treated alike.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in (out, redact)]
    chosen = df.select(*[F.col(f"`{c}`") for c in kept]).withColumn(out, F.lit(None).cast(_SPANS))
    schema = (chosen.withColumn(redact, F.lit(None).cast("string")) if redact else chosen).schema
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            every = batch.column(text).to_pylist()
            found = [find(x or "") for x in every]
            rows = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in x] for x in found]
            columns, names = [*[batch.column(c) for c in kept], pa.array(rows, _ARROW)], [*kept, out]
            if redact:
                columns.append(pa.array([x and redacted(x, s) for x, s in zip(every, found, strict=True)], pa.string()))
                names.append(redact)
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def op8(docs: DataFrame) -> DataFrame:
    """Spans of all documents, listed and digested."""
    found = detect(docs, keep=["doc_id"])
    listed = "array_join(transform({0}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    base = "filter(pii_spans, x -> x.kind in ('email', 'ip', 'card', 'phone'))"
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(pii_spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(listed.format(base)).cast("binary"), 256).alias("base_sha256"), F.expr(listed.format("pii_spans")).alias("spans"),
        F.expr("aggregate(pii_spans, 0D, (a, x) -> greatest(a, x.score))").alias("top_score"),
    )
