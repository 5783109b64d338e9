"""The queries of the training-data operators: name to (spark, sf_dir) -> DataFrame, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers

from . import bpe, conversations, decontamination, fingerprints, mpeg, near_dedup, packing, pii, quality, shards, spelling, substrings, token_counts
from .common import documents

QUERIES = {
    "op1_best_fit_packing": lambda spark, sf_dir: packing.op1(documents(spark, sf_dir)),
    "op2_byte_bpe": lambda spark, sf_dir: bpe.op2(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    "op3_minhash_near_dedup": lambda spark, sf_dir: near_dedup.op3(documents(spark, sf_dir)),
    "op4_iblt_fingerprints": lambda spark, sf_dir: fingerprints.op4(documents(spark, sf_dir)),
    "op5_substring_dedup": lambda spark, sf_dir: substrings.op5(documents(spark, sf_dir)),
    "op6_feistel_shards": lambda spark, sf_dir: shards.op6(documents(spark, sf_dir)),
    "op7_token_counts": lambda spark, sf_dir: token_counts.op7(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")),
    "op8_pii": lambda spark, sf_dir: pii.op8(documents(spark, sf_dir)),
    "op9_mpeg_audio": lambda spark, sf_dir: mpeg.op9(documents(spark, sf_dir)),
    "op10_quality": lambda spark, sf_dir: quality.op10(documents(spark, sf_dir)),
    "op11_decontamination": lambda spark, sf_dir: decontamination.op11(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
    "op12_spelling_variants": lambda spark, sf_dir: spelling.op12(documents(spark, sf_dir)),
    "op13_conversation_repair": lambda spark, sf_dir: conversations.op13(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
}

#: Every two documents that share a shingle are compared on their full sets; components are what recursion reaches.
_NEAR = r"""
WITH RECURSIVE
split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
listed AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s
  FROM split),
shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(s) AS s FROM listed)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reached.doc_id, ways.b FROM reached JOIN ways ON ways.a = reached.other)
SELECT r.doc_id, CAST(coalesce(any_value(sizes.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id, r.doc_id = min(r.other) AS kept
FROM reached r LEFT JOIN sizes ON sizes.doc_id = r.doc_id GROUP BY r.doc_id
"""

#: Every window of items, and as many words of a document from every place, as joined words.
_LEAKS = r"""
WITH
split AS (
  SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i + 9], ' '))) AS g
  FROM items WHERE len(w) > 0),
grams AS (
  SELECT r, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {'i': i, 'g': array_to_string(w[i:i + k - 1], ' ')})) AS x
  FROM split, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
found AS (SELECT r, x.i AS i, k, item_id FROM grams JOIN windows USING (k) WHERE x.g = g),
hits AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
met AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(met.n, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated
FROM split LEFT JOIN hits USING (r) LEFT JOIN met USING (r)
"""

#: Checksums byte by byte, by a table of what each byte does; ``bytes`` is a list of numbers.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"
_BYTES = "list_transform(range(0, CAST(octet_length(encode({x})) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"

#: Words, then every two that share a place with one replaced letter, or of which one is a deletion of the other; roots are what recursion reaches.
_VARIANTS = rf"""
WITH RECURSIVE
{_CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
hashed AS (SELECT run, n, {_CRC.format(bytes=_BYTES.format(x="(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)"))} AS h FROM runs, crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cuts AS MATERIALIZED (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM places),
open_ AS MATERIALIZED (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS g FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n FROM open_ a JOIN open_ b USING (g) WHERE a.word <> b.word
  UNION ALL SELECT cuts.word, words.word, words.n FROM cuts JOIN words ON words.word = cut
  UNION ALL SELECT words.word, cuts.word, longer.n FROM cuts JOIN words ON words.word = cut JOIN words longer ON longer.word = cuts.word),
counted AS (SELECT word, count(*) AS n_near FROM near GROUP BY 1),
best AS (SELECT word, other, n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(other)) = 1),
forms AS MATERIALIZED (SELECT words.word, best.other AS form, best.n AS form_n FROM words JOIN best USING (word) WHERE best.n >= 5 * words.n),
ways AS (
  SELECT word, form AS here, 1 AS depth FROM forms
  UNION ALL SELECT ways.word, forms.form, depth + 1 FROM ways JOIN forms ON forms.word = ways.here),
ends AS (SELECT word, arg_max(here, depth) AS root FROM ways GROUP BY 1)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM words LEFT JOIN counted USING (word) LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)
"""



def _least(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"


def _way(state: str, cost: str, letter: str, part: str | None, when: str = "true") -> str:
    """One edit more: cost, edits and repaired rows behind it."""
    return f"CASE WHEN {when} AND {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'p': {state}.p{f' || [{part}]' if part else ''}}} END"


def _repair_sql() -> str:
    """Damaged rows in order, then for each row the best way to each state of the pattern, a row a step; insertions may follow each row and come first."""
    kept, more = "r.fault IN (0, 3)", "CASE WHEN r.fault = 3 THEN 5 ELSE 0 END"
    to = lambda x, s: _way(f"w.{s}", more, "K", "r.role || ':' || r.text", f"{kept} AND r.initial = '{x}'")
    turn = lambda name, s: _way(f"w.{s}", f"1 + {more}", "R", f"'{name}:' || r.text", kept)
    gone = lambda s: _way(f"w.{s}", "2", "D", None)
    after = {
        "s0": gone("s0"),
        "s1": _least(gone("s1"), to("s", "s0")),
        "s2": _least(gone("s2"), *(f(x, s) for s in ("s0", "s1", "s3") for f, x in ((to, "u"), (turn, "user")))),
        "s3": _least(gone("s3"), to("a", "s2"), turn("assistant", "s2")),
    }
    user = _least("s2", *(_way(s, "5", "I", "'user:'") for s in ("s0", "s1", "s3")))
    widened = f"SELECT conv, i, s0, s1, u AS s2, {_least('s3', _way('u', '5', 'I', chr(39) + 'assistant:' + chr(39)))} AS s3 FROM (SELECT *, {user} AS u FROM @)"
    nothing = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, p VARCHAR[]))"
    return rf"""
WITH RECURSIVE
{_CRC_TABLE},
told AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format(bytes=_BYTES.format(x="(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))"))} % 20 AS how
  FROM conversations, crc),
damaged AS (
  SELECT conv, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM told),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, encode(role), sha256(length(role) || ':' || role || text)) AS i FROM damaged),
judged AS (
  SELECT conv, i, turn, role, text, left(role, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
    lead(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS following
  FROM placed),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY 1),
started AS (SELECT DISTINCT conv, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 'p': []}} AS STRUCT(c BIGINT, a VARCHAR, p VARCHAR[])) AS s0, {nothing} AS s1, {nothing} AS s2, {nothing} AS s3 FROM told),
ways AS (
  {widened.replace("@", "started")}
  UNION ALL
  {widened.replace("@", f"(SELECT w.conv, r.i, {', '.join(f'{x} AS {s}' for s, x in after.items())} FROM ways w JOIN judged r ON r.conv = w.conv AND r.i = w.i + 1)")}),
ends AS (SELECT conv, {_least("s0", "s3")} AS e FROM ways QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  e.c AS cost, e.a AS audit, sha256(array_to_string(e.p, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM told) JOIN ends USING (conv) LEFT JOIN counts USING (conv)
"""


ORACLE_SQL: dict[str, str] = {"op3_minhash_near_dedup": _NEAR, "op11_decontamination": _LEAKS, "op12_spelling_variants": _VARIANTS, "op13_conversation_repair": _repair_sql()}
