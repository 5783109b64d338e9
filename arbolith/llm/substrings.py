"""Substring deduplication: content-defined chunks by a gear rolling hash, deduplicated by digest; windows of words say which runs are long."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, Scratch, slices

#: A chunk ends behind white space where the rolling hash of the last WINDOW bytes is low: every WORDS words on average. The
#: hash sees nothing else, so chunks of a passage are the same in any document after its first few words.
WINDOW, WORDS = 16, 5
#: Where the last SPACELESS bytes hold no white space, as in Chinese, Japanese or Thai, a chunk may end at any character, every
#: CHARACTERS of them on average; a passage has the same chunks there too. WORD_BYTES bytes count as a word.
SPACELESS, CHARACTERS, WORD_BYTES = 32, 12, 12
#: Without such a place for so many bytes a chunk is cut at the next character.
LONGEST = 2048
#: A run of repeated chunks is taken out if it meets a repeated window: SPAN words in a row. Of any AMONG windows in a row the one
#: of least hash is looked up, so a passage of SPAN + AMONG - 1 = 51 words is met in any document, and under SPAN words none.
SPAN, AMONG = 34, 18
#: Windows hashed at once.
AT_ONCE = 1 << 14
#: Text without white space has no such windows; there a run is taken out if it has MANY_WORDS, or LEAST_WORDS with LEAST_SOLID bytes
#: in chunks of SOLID bytes at least: short chunks also repeat by chance, but not so many in a row.
LEAST_WORDS, LEAST_SOLID, SOLID, MANY_WORDS = 16, 64, 16, 32
#: Keys to which a hot digest is dealt.
SALTS = 64
_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Odd base of the hashes of windows.
_BASE = 0x9E3779B97F4A7C15
_BYTES = 32, 12, 12
#: Without such a place for so many bytes a chunk is cut at the next character.
LONGEST = 2048
#: A run of repeated chunks is taken out if it meets a repeated window: SPAN words in a row. Of any AMONG windows in a row the one
#: of least hash is looked up, so a passage of SPAN + AMONG - 1 = 51 words is met in any document, and under SPAN words none.
SPAN, AMONG = 34, 18
#: Windows hashed at once.
AT_ONCE = 1 << 14
#: Text without white space has no such windows; there a run is taken out if it has MANY_WORDS, or LEAST_WORDS with LEAST_SOLID bytes
#: in chunks of SOLID bytes at least: short chunks also repeat by chance, but not so many in a row.
LEAST_WORDS, LEAST_SOLID, SOLID, MANY_WORDS = 16, 64, 16, 32
#: Keys to which a hot digest is dealt.
SALTS = 64
_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Odd multipliers of the hashes of words and windows, and the inverse of the second modulo 2 ** 64.
_BY_BYTE, _BY_WORD = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_BACK = np.uint64(pow(_BY_WORD, -1, 1 << 64))
_BYTES = np.random.default_rng(20240608).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOW, _LOWER = np.uint32((1 << 16) // WORDS), np.uint32((1 << 16) // CHARACTERS)


def cut(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks of UTF-8 bytes; none for no bytes."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    h, step = _GEAR[raw], 1
    while step < WINDOW:  # the sum over gear[b] << age, doubling the ages in each step
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    seen = h >> np.uint32(8) & np.uint32(0xFFFF)
    space = _SPACE[raw]
    ends = np.flatnonzero(space & (seen < _LOW)) + 1
    last = np.flatnonzero(space)
    if n > SPACELESS and np.diff(last, prepend=-1, append=n).max() > SPACELESS:
        since = np.arange(n)
        since -= np.maximum.accumulate(np.where(space, since, -1))
        inner = np.flatnonzero((since[:-1] >= SPACELESS) & (seen[:-1] < _LOWER) & (raw[1:] & 0xC0 != 0x80)) + 1
        ends = np.union1d(ends, inner)
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() <= LONGEST:
        return ends
    out: list[int] = []
    for end, gap in zip(ends.tolist(), gaps.tolist(), strict=True):
        at = end - gap
        while end - at > LONGEST:
            at += LONGEST
            while at < end and raw[at] & 0xC0 == 0x80:
                at += 1
            if at < end:
                out.append(at)
        out.append(end)
    return np.array(out)


@functools.cache
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(length, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _sliding(choose: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """Of each n values in a row the least or greatest."""
    step = 1
    while 2 * step <= n:
        x, step = choose(x[:-step], x[step:]), 2 * step
    return choose(x[: step - n], x[n - step :]) if step < n else x


def _hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte ranges, which come in order and close to each other."""
    low, n = int(starts[0]), int(ends[-1] - starts[0])
    powers, back = _powers(max(1 << 12, 1 << n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw[low : low + n]] * powers[:n], out=total[1:])
    at = starts - low
    x = (total[ends - low] - total[at]) * back[at]
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def windows(raw: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, starts and ends of the windows of UTF-8 bytes that are looked up; none where there are under SPAN + AMONG - 1 words."""
    none = np.zeros(0, np.int64)
    if len(raw) < 2 * (SPAN + AMONG) - 3:
        return none, none, none
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = np.concatenate([none if space[0] else [0], edges, none if space[-1] else [len(raw)]])
    starts, ends = edges[::2], edges[1::2]
    if len(starts) < SPAN + AMONG - 1:
        return none, none, none
    starts, ends = starts[: 1 - SPAN], ends[SPAN - 1 :]
    hashes = np.concatenate([_hashed(raw, starts[i : i + AT_ONCE], ends[i : i + AT_ONCE]) for i in range(0, len(starts), AT_ONCE)])
    least = np.zeros(len(hashes) + AMONG - 1, np.uint64)
    least[AMONG - 1 : 1 - AMONG] = _sliding(np.minimum, hashes, AMONG)
    at = np.flatnonzero(_sliding(np.maximum, least, AMONG) == hashes)  # the least of a group that has it
    return hashes[at].view(np.int64), starts[at], ends[at]


def _rows(text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Digests of a text's chunks and windows, their packed places, and whether each repeats an earlier one of the text.

    The upper 32 bits of a place are its start, its last bit says whether it repeats an earlier one of the text, the one before whether it is a window.
    A window has its bytes between (30 bits). A chunk has its bytes (12 bits) and its words, by WORD_BYTES (8 bits), where these outnumber its white space.
    """
    data = (text or "").encode()
    raw = np.frombuffer(data, np.uint8)
    ends = cut(raw)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    digests = [xxhash.xxh64_intdigest(data[a:b]) - (1 << 63) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    space = _SPACE[raw]
    spaces = np.concatenate([[0], np.cumsum(space)])
    by_bytes = (ends - starts) // WORD_BYTES
    count = np.where(by_bytes > spaces[ends] - spaces[starts], np.minimum(255, by_bytes), 0) if len(ends) else ends
    met, first, last = windows(raw, space)
    digests += met.tolist()
    places = np.concatenate([starts << 32 | (ends - starts) << 20 | count << 12, first << 32 | (last - first) << 2 | 2])
    held: dict[int, int] = {}  # to the end of the first, as windows overlap
    ranges = zip(digests, np.concatenate([starts, first]).tolist(), np.concatenate([ends, last]).tolist(), strict=True)
    again = np.array([held.setdefault(d, b) <= a for d, a, b in ranges], bool)
    return digests, places | again, again


def _chunked(batches: Iterator[pa.RecordBatch], first_only: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        digests: list[int] = []
        ids, tags, places = [], [], []
        for k, tag, text in zip(*(batch.column(c).to_pylist() for c in ("_id", "_tag", "text")), strict=True):
            d, p, again = _rows(text)
            if first_only:
                digests += [x for x, a in zip(d, again.tolist(), strict=True) if not a]
                ids.append(np.full(len(d) - int(again.sum()), k, np.int64))
            else:
                digests += d
                ids.append(np.full(len(d), k, np.int64))
                tags.append(np.full(len(d), tag, np.int64))
                places.append(p)
        columns = [pa.array(digests, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *ids]))]
        if first_only:
            yield pa.RecordBatch.from_arrays(columns, ["digest", "_id"])
        else:
            columns += [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (tags, places)]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "_id", "_tag", "place"])


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _chunked(batches, True)


def _every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _chunked(batches, False)


def runs(places: list[int]) -> list[tuple[int, int]]:
    """Byte ranges to take out, from the packed places of a text's repeated chunks and windows."""
    out, start, end, words, solid, met = [], -1, -1, 0, 0, False
    for p in [*sorted(set(places)), None]:
        at = p >> 32 if p is not None else 1 << 40
        if at > end:
            if met or words >= MANY_WORDS or (words >= LEAST_WORDS and solid >= LEAST_SOLID):
                out.append((start, end))
            start, end, words, solid, met = at, at, 0, 0, False
        if p is None:
            break
        if p & 2:
            end, met = max(end, at + (p >> 2 & 0x3FFFFFFF)), True
        else:
            n, by_bytes = p >> 20 & 0xFFF, p >> 12 & 0xFF
            end, words, solid = max(end, at + n), words + by_bytes, solid + n * (n >= SOLID and by_bytes > 0)
    return out


def deduplicate(df: DataFrame, text: str = "text", id_col: str = "doc_id", spans: str = "removed_spans") -> DataFrame:
    """All columns with ``text`` rid of passages that other documents of lower id, or the text itself further up, hold too.

    Adds ``spans``: array of (start, end), byte offsets into the original text; a column of that name is replaced.
    The document of lowest id keeps its chunks. Rows of the same id count as one document for each other, so repeated rows
    keep theirs; null ids come after all others. A null or empty text stays as it is, an empty table stays empty. Of a text
    that is all repeated, an empty text remains. Passages under SPAN words stay; of SPAN + AMONG - 1 words and more none does. Digests are
    64 bits wide; a chance match of a chunk is too short for a run, and among a million million windows one in ten million meets another's digest.

    Each chunk's digest is counted with partial aggregation, so a chunk that a third of all documents share is one row a task.
    Where a digest is hot, its owner is dealt to SALTS keys, and so are its places. Places come back to their text by the id and 64
    bits of the whole text, as rows of a null or repeated id differ; copies under one id share theirs, so no list is longer
    than a text has chunks.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c != spans]
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_id"), F.col(text).alias("text"))
    rows = rows.withColumn("_tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    scratch = Scratch(spark)
    repeated = (
        rows.mapInArrow(_first, "digest long, _id long").groupBy("digest")
        .agg(F.min("_id").alias("owner"), F.max("_id").alias("last"), F.count("*").alias("n")).filter("owner < last").select("digest", "owner", "n")
    )
    repeated = scratch.written(repeated)
    is_hot = F.col("n") > max(1000, (repeated.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = F.broadcast(repeated.filter(is_hot).select("digest", F.lit(True).alias("_hot")))  # fewer than HOT rows
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    key = F.when(F.col("_salt") >= 0, F.xxhash64("digest", "_salt")).otherwise(F.col("digest")).alias("_key")
    owners = repeated.withColumn("_salt", F.explode(salts)).select(key, "owner")
    every = rows.mapInArrow(_every, "digest long, _id long, _tag long, place long").join(hot, "digest", "left")
    every = every.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_id", "_tag"), F.lit(SALTS)).cast("int")).otherwise(-1)).select(key, "_id", "_tag", "place")
    found = every.join(owners, "_key", "left").filter("place & 1 = 1 or _id > owner").select("_id", "_tag", "place")
    gathered = found.groupBy("_id", "_tag").agg(F.collect_set("place").alias("_places"))
    whole = df.select(*[F.col(f"`{c}`") for c in kept]).withColumn("_id", F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1)))
    whole = whole.withColumn("_tag", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    joined = whole.join(gathered, ["_id", "_tag"], "left").drop("_id", "_tag")
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).withColumn(spans, F.lit(None).cast("array<struct<start:int,end:int>>")).schema
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            taken, out = [], []
            for x, places in zip(batch.column(text).to_pylist(), batch.column("_places").to_pylist(), strict=True):
                ranges = runs(places) if places else []
                taken.append([{"start": a, "end": b} for a, b in ranges])
                if ranges:
                    data, at, parts = x.encode(), 0, []
                    for a, b in ranges:
                        parts.append(data[at:a])
                        at = b
                    x = b"".join([*parts, data[at:]]).decode()
                out.append(x)
            columns = [pa.array(out, pa.string()) if c == text else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(taken, arrow)], [*kept, spans])

    return joined.mapInArrow(strip, schema)


def op5(docs: DataFrame) -> DataFrame:
    """Documents without repeated passages: the text that is left, the byte ranges taken out and their length."""
    out = deduplicate(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", "text", F.expr("aggregate(removed_spans, 0L, (a, x) -> a + x.end - x.start)").alias("removed_bytes"),
        F.expr("array_join(transform(removed_spans, x -> concat_ws(':', x.start, x.end)), ',')").alias("removed_spans"),
    )
