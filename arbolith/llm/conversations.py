"""Conversation structure repair: the cheapest edits that make roles alternate, as a shortest path found with Dial's bucket queue.

A node is a row number and a state of the pattern ``(s?(ua)+)?`` of role initials; edits are arcs of small integer cost. Distances to the end come first, then
a walk along tight arcs, at each node by the one whose letter is least, gives the edits ("audit"): D(elete), I(nsert), K(eep), R(erole).

A conversation may be of any length. Rows without their texts, a byte each, are dealt to tasks by ranges of (conversation, turn), so a long one lies in
several tasks, and in segments of bounded length there. Segments of conversations that may have others elsewhere are solved for each state that they can be
entered in and left in; what follows a segment is then four costs, what comes before it is one state, and both are carried from segment to segment.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

#: Costs of edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a segment.
SEGMENT = 4096
#: States: nothing yet, behind s, behind u, behind a. By what may follow and where that leads.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_FAR = 1 << 40
#: What is left to pay behind the last row: closing insertions.
_END = (0, 2 * INSERT, INSERT, 0)
#: Buckets in use at a time: more than any arc costs, and than the costs of two states can differ by.
_BUCKETS = 16
#: Fault of a row, two bits, and initial of its role, two bits.
FINE, BLANK, DUPLICATE, CUT = range(4)
_INITIALS = "sua?"
_ROLES = {"u": "user", "a": "assistant"}


def _wanted(state: int) -> str:
    return "a" if state == 2 else "u"


def _edits(code: int) -> list[tuple[int, str, int, int]]:
    """Arcs over a row: state before, letter, cost, state behind."""
    fault, initial = code & 3, _INITIALS[code >> 2]
    out = [(s, "D", DELETE, s) for s in range(4)]
    if fault in (FINE, CUT):
        more = TRUNCATED * (fault == CUT)
        out += [(s, "K", more, _NEXT[s][initial]) for s in range(4) if initial in _NEXT[s]]
        out += [(s, "R", REROLE + more, _NEXT[s][_wanted(s)]) for s in range(4)]
    return out


_INSERTS = [(s, "I", INSERT, _NEXT[s][_wanted(s)]) for s in range(4)]
_INTO = [[[(a, c) for a, _, c, b in _edits(code) if b == s] for s in range(4)] for code in range(16)]
_INSERTED = [[a for a, _, _, b in _INSERTS if b == s] for s in range(4)]
_FROM = [[sorted([(x, c, b, 1) for a, x, c, b in _edits(code) if a == s] + [(x, c, b, 0) for a, x, c, b in _INSERTS if a == s]) for s in range(4)] for code in range(16)]


def distances(codes: bytes, leave: tuple[int, ...]) -> list[int]:
    """Least cost from node ``4 * row + state`` to the end, where leaving in a state costs ``leave``; insertions behind the last row are part of that.

    Dial's algorithm, from the end: nodes wait in a ring of buckets by their distance.
    """
    n = len(codes)
    dist = [_FAR] * (4 * n + 4)
    ring: list[list[int]] = [[] for _ in range(_BUCKETS)]
    least = min(leave)
    waiting = 0
    for s in range(4):
        if leave[s] < _FAR:
            dist[4 * n + s] = leave[s]
            ring[leave[s] % _BUCKETS].append(4 * n + s)
            waiting += 1
    d = least
    while waiting:
        bucket = ring[d % _BUCKETS]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != d:
                continue
            row, s = node >> 2, node & 3
            if row < n:
                for a in _INSERTED[s]:
                    to = node - s + a
                    if d + INSERT < dist[to]:
                        dist[to] = d + INSERT
                        ring[(d + INSERT) % _BUCKETS].append(to)
                        waiting += 1
            if row:
                base = node - s - 4
                for a, c in _INTO[codes[row - 1]][s]:
                    if d + c < dist[base + a]:
                        dist[base + a] = d + c
                        ring[(d + c) % _BUCKETS].append(base + a)
                        waiting += 1
        d += 1
    return dist


@functools.lru_cache(1 << 15)
def _short(codes: bytes, leave: tuple[int, ...], state: int) -> tuple[str, int, int]:
    return _walk(codes, leave, state)


def _walk(codes: bytes, leave: tuple[int, ...], state: int) -> tuple[str, int, int]:
    dist = distances(codes, leave)
    out: list[str] = []
    row, cost = 0, 0
    while row < len(codes):
        here = dist[4 * row + state]
        for letter, c, to, step in _FROM[codes[row]][state]:
            if here == c + dist[4 * (row + step) + to]:
                out.append(letter)
                row, state, cost = row + step, to, cost + c
                break
    return "".join(out), state, cost


def walk(codes: bytes, leave: tuple[int, ...], state: int = 0) -> tuple[str, int, int]:
    """The least edits, in ASCII order, of those that cost least from ``state`` on; the state behind them and their cost."""
    return (_short if len(codes) <= 32 else _walk)(codes, leave, state)


def closing(state: int) -> tuple[str, int]:
    """Edits behind the last row, and their cost."""
    return "I" * (_END[state] // INSERT), _END[state]


def through(codes: bytes) -> list[int]:
    """Least costs from each state in front of the rows to each state behind them: 16 numbers."""
    by_exit = [distances(codes, tuple(0 if s == x else _FAR for s in range(4))) for x in range(4)]
    return [min(by_exit[x][a], _FAR) for a in range(4) for x in range(4)]


class Account:
    """What is reported of a conversation, of segments in order."""

    def __init__(self):
        self.gaps = [0, None, None]  # turns, least, greatest
        self.faults, self.illegal, self.cost, self.last = [0] * 4, 0, 0, ""
        self.audit: list[str] = []

    def add(self, codes: bytes, turns: int, first: int | None, last: int | None, audit: str, cost: int) -> None:
        for c in codes:
            self.faults[c & 3] += 1
            initial = _INITIALS[c >> 2]
            self.illegal += bool(self.last) and self.last + initial not in ("su", "ua", "au")
            self.last = initial
        if turns:
            self.gaps = [self.gaps[0] + turns - (self.gaps[2] == first), first if self.gaps[1] is None else self.gaps[1], last]
        self.audit.append(audit)
        self.cost += cost

    def row(self, conv, state: int) -> tuple:
        turns, first, last = self.gaps
        audit, cost = closing(state)
        return (conv, last - first + 1 - turns if turns else 0, *self.faults[1:], self.illegal, self.cost + cost, "".join([*self.audit, audit]))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as the repair is to find them, by checksum of ``conv_id:turn``: dropped (``copies`` 0), emptied, without marks at sentence ends, twice, of role user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("how")).select(
        "conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("how") == 0, 0).when(F.col("how") == 3, 2).otherwise(1).alias("copies"),
    )


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))


def _light(rows: DataFrame) -> DataFrame:
    """Rows without texts, equal ones as one: ``conv_id, turn, role, key, copies, code, again``; ``again`` where an earlier turn has the same."""
    bare = F.expr("trim(BOTH ' \\t\\n\\u000B\\f\\r' FROM text)")
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)
    initial = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 4).when(F.startswith("role", F.lit("a")), 8).otherwise(12)
    here = F.col("copies") > 0
    # A dropped row only says that there is such a conversation.
    thin = rows.select("conv_id", F.when(here, F.col("turn")).alias("turn"), F.when(here, F.col("role")).otherwise("").alias("role"), F.when(here, _digest()).otherwise(F.lit(b"")).alias("key"), "copies", (fault + initial).alias("code"))
    marked = thin.withColumn("code", F.when(here, F.col("code")).otherwise(0))
    one = marked.groupBy("conv_id", "turn", "role", "key", "code").agg(F.sum("copies").alias("copies"))
    same = Window.partitionBy("conv_id", "key")
    return one.withColumns({"least": F.min("turn").over(same), "null": F.max(F.col("turn").isNull()).over(same)}).select("conv_id", "turn", "role", "key", "copies", "code", F.expr("turn is not null and (`null` or turn > least)").alias("again"))


_PIECES = "conv_id long, part int, seg long, codes binary, turns long, first long, last long, ways array<long>"
_ACCOUNT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _batch(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(like)], schema=like)


_ID = pa.int64()
_PIECE_ARROW = pa.schema([("conv_id", _ID), ("part", pa.int32()), ("seg", _ID), ("codes", pa.binary()), ("turns", _ID), ("first", _ID), ("last", _ID), ("ways", pa.list_(_ID))])
_ACCOUNT_ARROW = pa.schema([("conv_id", _ID), *((n, _ID) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])


def _tuples(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in slices(batches, 4096):
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _packed(rows: Iterable[tuple], like: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of few rows and bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, (bytes, str)))
        if len(held) >= 2048 or size > 4 << 20:
            yield _batch(held, like)
            held, size = [], 0
    if held:
        yield _batch(held, like)


def _cut(rows: Iterator[tuple], part: int, segment: int) -> Iterator[tuple]:
    """Segments of sorted rows; ``ways`` is null for a conversation that this task has whole, as it begins and ends here in one segment."""
    codes, first, last, turns, seg, conv, started, alone = bytearray(), None, None, 0, 0, None, False, False

    def piece(whole: bool) -> tuple:
        found = bytes(codes)
        return conv, part, seg, found, turns, first, last, None if whole else through(found)

    for c, turn, copies, code, again in rows:
        if not started or c != conv:
            if started:
                yield piece(alone and seg_at == seg)
            alone = started  # the first of a partition may have begun in another
            started, conv = True, c
            codes, first, last, turns = bytearray(), None, None, 0
            seg += 1
            seg_at = seg
        while copies:
            if len(codes) == segment:
                yield piece(False)
                codes, first, last, turns = bytearray(), None, None, 0
                seg += 1
            if again and code & 3 in (FINE, CUT):
                code = code & 12 | DUPLICATE
            if turn is not None and turn != last:
                first, last, turns = turn if first is None else first, turn, turns + 1
            codes.append(code)
            again, copies = True, copies - 1
    if started:
        yield piece(False)  # the last may go on in another


def _settled(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Conversations in one segment."""
    for conv, codes, turns, first, last in rows:
        account = Account()
        audit, state, cost = walk(codes, _END)
        account.add(codes, turns, first, last, audit, cost)
        yield account.row(conv, state)


def _leaving(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of segments from a conversation's last on: what leaving in each state will cost, in place of ``ways``."""
    before, leave = object(), _END
    for conv, part, seg, codes, turns, first, last, ways in rows:
        if conv != before:
            before, leave = conv, _END
        yield conv, part, seg, codes, turns, first, last, list(leave)
        leave = tuple(min(ways[4 * s + x] + leave[x] for x in range(4)) for s in range(4))


def _walked(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Segments with their edits from each state: four strings of letters, states and costs."""
    for conv, part, seg, codes, turns, first, last, leave in rows:
        found = [walk(codes, tuple(leave), s) for s in range(4)]
        yield conv, part, seg, codes, turns, first, last, *(list(x) for x in zip(*found, strict=True))


def _chained(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Conversations of segments in order, each entered in the state that the one before is left in."""
    before, account, state = object(), None, 0
    for conv, codes, turns, first, last, audits, states, costs in rows:
        if account is None or conv != before:
            if account is not None:
                yield account.row(before, state)
            before, account, state = conv, Account(), 0
        account.add(codes, turns, first, last, audits[state], costs[state])
        state = states[state]
    if account is not None:
        yield account.row(before, state)


def _mapped(df: DataFrame, step, names: list[str], schema: str, arrow: pa.Schema) -> DataFrame:
    return df.select(*names).mapInArrow(lambda batches: _packed(step(_tuples(batches, names)), arrow), schema)



def audits(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Of each conversation of ``conv_id, turn, role, text, copies`` its counts, the least cost of repair and the edits. See ``repair``. ``segment`` changes no result."""
    place = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("key")]
    dealt = _light(rows).repartitionByRange(*place).sortWithinPartitions(*place)
    names = ["conv_id", "turn", "copies", "code", "again"]
    pieces = written(dealt.select(*names).mapInArrow(lambda b: _packed(_cut(_tuples(b, names), TaskContext.get().partitionId(), segment), _PIECE_ARROW), _PIECES))
    whole = _mapped(pieces.filter("ways is null"), _settled, ["conv_id", "codes", "turns", "first", "last"], _ACCOUNT, _ACCOUNT_ARROW)
    back = pieces.filter("ways is not null").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seg"))
    ends = _mapped(back, _leaving, pieces.columns, _PIECES, _PIECE_ARROW)
    extra = [("audits", pa.list_(pa.string())), ("states", pa.list_(_ID)), ("costs", pa.list_(_ID))]
    arrow = pa.schema([*list(_PIECE_ARROW)[:-1], *(pa.field(n, t) for n, t in extra)])
    walked = _mapped(ends.repartition("conv_id", "part", "seg"), _walked, pieces.columns, _PIECES.rsplit(",", 1)[0] + ", audits array<string>, states array<long>, costs array<long>", arrow)
    forth = walked.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    return whole.unionByName(_mapped(forth, _chained, ["conv_id", "codes", "turns", "first", "last", "audits", "states", "costs"], _ACCOUNT, _ACCOUNT_ARROW))


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Repaired rows ``conv_id, place, role, text``, of an audit and its rows in order. A conversation without any gives one with a null place."""
    conv, audit, at, place, state = None, "", 0, 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            wanted = _wanted(state)
            state = _NEXT[state][wanted]
            yield conv, place, _ROLES[wanted], ""
            at, place = at + 1, place + 1

    for c, letters, role, text, copies in rows:
        if letters is not None:
            conv, audit, at, place, state = c, letters, 0, 0, 0
            yield conv, None, None, None
            yield from inserted()
            continue
        for _ in range(copies):
            edit = audit[at]
            at += 1
            if edit != "D":
                wanted = role[0] if edit == "K" else _wanted(state)
                state = _NEXT[state][wanted]
                yield conv, place, role if edit == "K" else _ROLES[wanted], text
                place += 1
            yield from inserted()


def _hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``conv_id`` and the digest of its repaired rows, of which only one at a time is in memory."""
    before, digest = None, None
    for conv, place, role, text in _edited(rows):
        if place is None:
            if digest is not None:
                yield before, digest.hexdigest()
            before, digest = conv, hashlib.sha256()
        else:
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
    if digest is not None:
        yield before, digest.hexdigest()


def _together(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Audits, each followed by its conversation's rows in order."""
    texts = rows.filter("copies > 0").select("conv_id", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("tag"), "turn", "role", _digest().alias("key"), "text", "copies")
    heads = found.select("conv_id", "audit", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"))
    return heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "tag", F.asc_nulls_first("turn"), "role", "key").select("conv_id", "audit", "role", "text", "copies")


_HEADS = ["conv_id", "audit", "role", "text", "copies"]


def repair(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place, role, text``, by ``audits`` of the same rows.

    Rows are taken by turn, nulls first; those of one turn by role, then by digest of role and text. Null roles and texts are to be replaced before. ``conv_id`` null is a
    conversation like others.
    """
    arrow = pa.schema([("conv_id", _ID), ("place", _ID), ("role", pa.string()), ("text", pa.string())])
    return _together(rows, found).mapInArrow(lambda b: _packed((r for r in _edited(_tuples(b, _HEADS)) if r[1] is not None), arrow), "conv_id long, place long, role string, text string")


def op13(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Damages conversations and gives what repairs them. Null ids are one conversation; repeated rows are duplicates; an empty table gives an empty one.

    The digest of a conversation has to read its texts one after the other, so they stream through one task, one row in memory at a time; all before that is dealt in segments.
    """
    rows = damaged(conversations)
    found = written(audits(rows, segment))
    arrow = pa.schema([("conv_id", _ID), ("repaired_sha256", pa.string())])
    hashes = _together(rows, found).mapInArrow(lambda b: _packed(_hashed(_tuples(b, _HEADS)), arrow), "conv_id long, repaired_sha256 string")
    return found.join(hashes.withColumnRenamed("conv_id", "c"), F.expr("conv_id <=> c")).drop("c")
