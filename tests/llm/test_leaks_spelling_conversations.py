"""Decontamination, spelling variants and conversation repair against brute force, on small tables with the awkward rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from arbolith.llm import conversations, decontamination, queries, spelling
from arbolith.session import ship

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n_words int, items string, word string"
ITEMS = "item_id long, text string, spans int"
TURNS = "conv_id long, turn long, role string, text string, audit int, copies string"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# -- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text: str | None, items) -> tuple[int, set[int], set[str], list]:
    found = list(WORD.finditer(lower(text or "")))
    words, hit, ids = [m[0] for m in found], set(), set()
    for item, source in items:
        w = WORD.findall(lower(source or ""))
        k = min(10, len(w))
        for window in {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else ():
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) == window:
                    hit |= set(range(i, i + k))
                    ids |= {str(item)} - {"None"}
    return len(words), hit, ids, found


def leak_tables(spark):
    r = random.Random(7)
    letters = ["alpha", "Beta", "ÇA", "日本", "x1", "9", "é", "delta"]
    some = lambda n: " ".join(r.choice(letters) + r.choice(["", ",", ".", "!\n"]) for _ in range(n))
    items = [(1, some(30)), (10, some(12)), (2, "Short answer"), (3, ""), (None, some(11)), (4, None), (5, "..!"), (2, "Short answer"), (6, "é")]
    texts = [None, "", " \n", "short ANSWER", "a short-answer, short answer", "é", "É", some(300), f"{some(20)} {items[0][1]} {some(20)}", f"é{items[1][1]}", items[4][1].upper(), " ".join(["short answer"] * 500)]
    texts += ["no " + " ".join(items[0][1].split()[3:20]) + " no", some(9), "short", "answer short"]
    docs = [(i, t, "en", 1, "x", "y") for i, t in enumerate(texts)] + [(None, texts[8], None, None, None, None), (3, "other", "", 0, "", "")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([(a, b, 0) for a, b in items], ITEMS), docs, items


def test_op11_by_brute_force(spark):
    docs, items, rows, pairs = leak_tables(spark)
    want = []
    for row in rows:
        n, hit, ids, _ = brute_hits(row[1], pairs)
        want.append((row[0], n, len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    got = decontamination.op11(docs, items)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_texts_are_scanned_part_by_part(spark):
    _, _, rows, pairs = leak_tables(spark)
    machine = decontamination.Automaton([(None if i is None else str(i), t) for i, t in pairs])
    for row in rows:
        n, hit, ids, _ = brute_hits(row[1], pairs)
        for size in (1, 16, 1 << 20):
            runs, found = [], set()
            assert machine.scan(decontamination.normal(row[1]), runs, found, size) == n
            assert {i for a, b in runs for i in range(a, b)} == hit and found == ids


@pytest.mark.parametrize("size", [1 << 20, 60])
def test_spans_and_blocks_of_items(spark, size):
    """The same whether items fit one automaton or many; spans are places in the original text."""
    docs, items, rows, pairs = leak_tables(spark)
    got = {(r.doc_id, r.text): r for r in decontamination.scan(docs, items, block_bytes=size).collect()}
    for row in rows:
        _, hit, ids, found = brute_hits(row[1], pairs)
        spans: list[list[int]] = []
        for i in sorted(hit):
            if i - 1 in hit:
                spans[-1][1] = found[i].end()
            else:
                spans.append([found[i].start(), found[i].end()])
        r = got[row[0], row[1]]
        assert [[s.start, s.end] for s in r.spans] == spans and list(r["items"]) == sorted(ids) and r.n_hit == len(hit) and r.lang == row[2]


def test_nothing_to_scan_or_to_look_for(spark):
    docs, items, rows, _ = leak_tables(spark)
    assert decontamination.op11(docs.limit(0), items).collect() == []
    assert {r.n_hit for r in decontamination.op11(docs, items.limit(0)).collect()} == {0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_decontamination", "op12_spelling_variants", "op13_conversation_repair"])
def test_queries_give_what_their_sql_gives(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_sql_of_conversations_on_awkward_rows():
    rows = turns(8)
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert set(con.sql(queries.ORACLE_SQL["op13_conversation_repair"]).fetchall()) == brute_repair(rows)


# -- spelling variants


def brute_variants(rows):
    count: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            count[w] += 1
    kept = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, near = {}, {}
    for w in kept:
        others = [x for x in kept if one_edit(w, x)]
        best = min(others, key=lambda x: (-kept[x], x), default=None)
        near[w], form[w] = len(others), best if best and kept[best] >= 5 * kept[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, near[w], kept.get(form[w])) for w, n in kept.items()}


def test_op12_by_brute_force(spark):
    r = random.Random(3)
    stems = ["letters", "letter", "lettérs", "llettes", "better", "betters", "aaaaaa", "aaaaaaa", "aaaaaaaa", "zebras", "zebra", "ÀÇéèêë", "Straßen", "÷×÷×÷×", "abcdef", "abcdxf", "abcdyf"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = r.choices(stems, [2 ** (k % 9) for k in range(len(stems))])[0]
            if r.random() < 0.1:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + "e" + w[at:], w[:at] + "s" + w[at + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", ", ", "-", "1", "\n"]).join(words)))
    rows += [(None, "letters betters 日本 letters"), (0, None), (1, ""), (2, "q" * 5000), *[(9, "letters  zebras")] * 7, (None, None)]
    docs = spark.createDataFrame([(i, t, "en", 1, "x", "y") for i, t in rows], DOCS)
    got = spelling.op12(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert (want := brute_variants(rows)) == {tuple(x) for x in got.collect()} and got.count() == len(want)
    assert any(w[2] != w[1] for w in want if w[1]) or any(w[1] for w in want)
    assert spelling.op12(docs.limit(0)).collect() == []


def test_chains_of_forms_lead_to_their_end(spark):
    """Each word is five times as common as the one before, over more steps than one doubling."""
    words = ["baaaaaaa", "bbaaaaaa", "bbbaaaaa", "bbbbaaaa", "bbbbbaaa"]
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(zip(words, [5, 25, 125, 625, 3125], strict=True))]
    docs = spark.createDataFrame([(i, t, "en", 1, "x", "y") for i, t in rows], DOCS)
    assert {tuple(r) for r in spelling.variants(docs).collect()} == {(w, *([words[k + 1], words[-1]] if k < 4 else [None, w]), 5 ** (k + 1), (k > 0) + (k < 4), 5 ** (k + 2) if k < 4 else None) for k, w in enumerate(words)}


def test_no_pairs_are_made(spark):
    docs = spark.createDataFrame([(1, "letters", "en", 1, "x", "y")], DOCS)
    plan = spelling.nearest(spelling.vocabulary(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


# -- conversation repair


def brute_repair(rows):
    """Damages, then finds the least (cost, edits) by trying all arcs from each place and state."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = groups[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(key.encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        kept += [(turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    out = set()
    for conv, kept in groups.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in kept:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        first = [r[:1] for _, r, _ in kept]
        step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
        best = {0: (0, "", [])}

        def widen(at):
            for _ in range(4):
                for (s, x), t in step.items():
                    if x != "s" and s in at:
                        c, e, p = at[s]
                        new = (c + 5, e + "I", [*p, ("user:" if x == "u" else "assistant:")])
                        if t not in at or new[:2] < at[t][:2]:
                            at[t] = new
            return at

        widen(best)
        for (_, role, text), fault in zip(kept, faults, strict=True):
            after: dict = {}

            def offer(s, new, after=after):
                if s not in after or new[:2] < after[s][:2]:
                    after[s] = new

            for s, (c, e, p) in best.items():
                offer(s, (c + 2, e + "D", p))
                if fault in ("", "truncated"):
                    more = 5 * (fault == "truncated")
                    if (s, role[:1]) in step:
                        offer(step[s, role[:1]], (c + more, e + "K", [*p, f"{role}:{text}"]))
                    for x, name in (("u", "user"), ("a", "assistant")):
                        if (s, x) in step:
                            offer(step[s, x], (c + more + 1, e + "R", [*p, f"{name}:{text}"]))
            best = widen(after)
        cost, audit, parts = min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])
        out.add((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
                 sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False)), cost, audit, sha("\n".join(parts))))
    return out


def turns(seed: int):
    r = random.Random(seed)
    rows = []
    for conv in range(120):
        for turn in range(r.choice([1, 1, 2, 3, 5, 8, 13])):
            role = r.choice(["system", "user", "assistant", "tool", "", None, "User", "s", "assistant", "user"])
            text = r.choice([None, "", " \t\v", "Hello.", "Hello", "Why?", "No! ", "ends so ", "日本。", f"Number {turn}.", "a" * 2000 + "."])
            rows.append((conv, turn if r.random() < 0.9 else r.choice([None, turn // 2, turn + 3]), role, text))
    rows += [(None, t, "user", "No id.") for t in (None, 1, 1, 2)] + [(500 + i, 0, "user", "Drop?") for i in range(60)] + [(7, 3, "user", "Same.")] * 40
    return rows


@pytest.mark.parametrize("segment", [conversations.SEGMENT, 3])
def test_op13_by_brute_force(spark, segment):
    """Also with segments of three rows, so that most conversations are put together from several."""
    rows = turns(segment)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(5)
    got = conversations.op13(table, segment)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = brute_repair(rows)
    assert {tuple(r) for r in got.collect()} == want and len(want) == len({r[0] for r in rows})
    assert conversations.op13(table.limit(0)).collect() == []


def test_a_long_conversation_is_dealt_in_segments(spark):
    """One conversation has nearly all rows: tasks get parts of it, and the result is that of one walk over all."""
    r = random.Random(11)
    rows = [(1, t, r.choice(["user", "assistant", "user", "system"]), r.choice(["Yes.", f"Turn {t}.", "cut off", ""])) for t in range(9000)] + [(2, 0, "user", "Hi."), (0, 0, "user", "Hi.")]
    table = spark.createDataFrame([(*x, 1, "x") for x in rows], TURNS)
    assert {tuple(x) for x in conversations.op13(table).collect()} == brute_repair(rows)


def test_segments_put_together_cost_what_the_whole_costs():
    r = random.Random(5)
    for _ in range(200):
        codes = bytes(r.randrange(16) for _ in range(r.randrange(1, 30)))
        cut = r.randrange(len(codes) + 1)
        whole = conversations.walk(codes, conversations._END)
        ways = conversations.through(codes[cut:])
        leave = tuple(min(ways[4 * s + x] + conversations._END[x] for x in range(4)) for s in range(4))
        a, state, c = conversations.walk(codes[:cut], leave)
        b, end, d = conversations.walk(codes[cut:], conversations._END, state)
        assert (a + b, end, c + d) == whole


def test_repaired_rows_alternate(spark):
    rows = conversations.damaged(spark.createDataFrame([(*r, 1, "x") for r in turns(2)], TURNS))
    fixed = defaultdict(str)
    for r in conversations.repair(rows, conversations.audits(rows)).orderBy("conv_id", "place").collect():
        fixed[r.conv_id] += r.role[0]
    assert fixed and all(re.fullmatch("(s?(ua)+)?", x) for x in fixed.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_op13_on_the_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = brute_repair([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert {tuple(r) for r in conversations.op13(table).select(F.expr("*")).collect()} == want
