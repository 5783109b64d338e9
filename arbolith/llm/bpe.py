"""Byte-level BPE by ranks: encoding with a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts
from .splitting import Splitter

#: Matches kept with their ids in a Python worker.
CACHE = 500_000


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file, read where the driver runs (a vocabulary is of fixed size)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match.

    A segment tree over byte positions holds at each leaf the rank of the pair that starts there (with the position, so that
    the root is the leftmost pair of least rank). A merge changes three leaves: the pair itself, the one that its right part
    started, and the one that ends in it; each update takes a path to the root.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    shift = size.bit_length()
    none = 1 << 62
    tree = [none] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    following = list(range(1, n + 1))  # where the token that starts here ends, for starts of live tokens
    before = list(range(-1, n))
    mask = (1 << shift) - 1

    def put(i: int, key: int) -> None:
        k = size + i
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            best = a if a < b else b
            if tree[k] == best:
                break
            tree[k] = best
            k >>= 1

    while (top := tree[1]) < none:
        i = top & mask
        j = following[i]  # the right part, which goes
        end = following[i] = following[j]
        before[end] = i
        put(j, none)
        r = get(piece[i : following[end]]) if end < n else None
        put(i, none if r is None else r << shift | i)
        if (p := before[i]) >= 0:
            r = get(piece[p:end])
            put(p, none if r is None else r << shift | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : following[i]]])
        i = following[i]
    return out


#: Matches up to this many bytes are merged together, a row of a matrix each; longer ones by ``merge``.
TOGETHER = 64
_NONE = np.int64(1) << 60


class Pairs:
    """Rank of the token that two tokens make, for arrays of token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    found[a << 30 | b] = rank
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.first = np.array([ranks.get(bytes([a, b]), _NONE) for a in range(256) for b in range(256)], np.int64)
        # open addressing: a key lies in the first free place from its hash on
        self.mask = (1 << (2 * len(found) + 1).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.full(self.mask + 1, _NONE)
        for key, rank in found.items():
            at = self._hash(np.array([key]))[0]
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at] = key, rank

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, or _NONE; ids below 0 make no pair."""
        keys = np.where((left < 0) | (right < 0), -2, left << 30 | right)
        at = self._hash(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.ranks[at], _NONE)
        left_over = np.flatnonzero((met != keys) & (met >= 0) & (keys >= 0))
        while len(left_over):
            at[left_over] = (at[left_over] + 1) & self.mask
            met = self.keys[at[left_over]]
            hit = met == keys[left_over]
            out[left_over[hit]] = self.ranks[at[left_over[hit]]]
            left_over = left_over[~hit & (met >= 0)]
        return out


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """``merge`` for many pieces of 2 to TOGETHER bytes: the same trees, a row for each piece, all pieces a merge further in each step.

    Rows lie one after the other in flat arrays: ``wide`` places a row for positions, twice ``size`` for tree nodes.
    """
    if not pieces:
        return []
    lengths = np.array([len(x) for x in pieces])
    size = 1 << int(lengths.max() - 1).bit_length()
    wide = size + 1
    raw = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in pieces), np.uint8).reshape(-1, wide)
    inside = np.arange(wide) < lengths[:, None]
    token = np.where(inside, pairs.bytes[raw], -1).ravel()
    following = np.tile(np.arange(1, wide + 1), len(pieces))
    before = np.tile(np.arange(-1, size), len(pieces))
    live = inside.ravel().copy()
    first = np.where(inside[:, 1:], pairs.first[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]], _NONE)
    tree = np.full((len(pieces), 2 * size), _NONE)
    tree[:, size:] = np.where(first < _NONE, first * size + np.arange(size), _NONE)
    k = size >> 1
    while k:
        tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        k >>= 1
    tree = tree.ravel()
    rows = np.arange(len(pieces))
    trees, places = rows * (2 * size), rows * wide
    while True:
        top = tree[trees + 1]
        if not (going := top < _NONE).all():
            top, trees, places = top[going], trees[going], places[going]
        if not len(top):
            break
        made, i = np.divmod(top, size)
        at = places + i
        j = following[at]  # the right part, which goes
        gone = places + j
        end = following[gone]
        following[at] = end
        before[places + end] = i
        token[at] = made
        token[gone] = -1
        live[gone] = False
        p = before[at]
        none = p < 0
        both = pairs(np.concatenate([made, np.where(none, -1, token[places + p])]), np.concatenate([token[places + end], made]))
        after, ahead = both[: len(i)], both[len(i) :]
        p = np.where(none, j, p)  # the leaf of the part that went holds none, as this one does
        tree[trees + (j + size)] = _NONE
        tree[trees + (i + size)] = np.where(after < _NONE, after * size + i, _NONE)
        tree[trees + (p + size)] = np.where(ahead < _NONE, ahead * size + p, _NONE)
        nodes = np.concatenate([i, j, p]) + size
        base = np.tile(trees, 3)
        for _ in range(size.bit_length() - 1):
            nodes >>= 1
            two = base + 2 * nodes
            tree[base + nodes] = np.minimum(tree[two], tree[two + 1])
    ids = token[live].astype("<u4").tobytes()
    ends = np.cumsum(live.reshape(-1, wide).sum(axis=1)) * 4
    return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Encoder:
    """Encodes whole texts without special tokens: each match of the pattern by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = Pairs(ranks)
        self.find = Splitter(pattern)
        self.known: dict[str, bytes] = {}

    def _learn(self, matches: set[str]) -> dict[str, bytes]:
        """Ids of matches that aren't known; those of matches too long to keep are returned only."""
        if len(self.known) > CACHE:
            self.known.clear()
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        long: dict[str, bytes] = {}
        for m in matches:
            if m in self.known:
                continue
            raw = m.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.known[m] = whole.to_bytes(4, "little")
            elif len(raw) > TOGETHER:
                long[m] = array("I", merge(raw, self.ranks)).tobytes()
            else:
                group = by_size.setdefault((len(raw) - 1).bit_length(), ([], []))
                group[0].append(m)
                group[1].append(raw)
        for names, raws in by_size.values():
            self.known.update(zip(names, merge_many(raws, self.pairs), strict=True))
        return long

    def encode_all(self, many: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found = [self.find(x) for x in many]
        every = set().union(*found)
        long = self._learn(every if len(self.known) > CACHE else every.difference(self.known))
        self.known.update(long)
        out = [b"".join(map(self.known.__getitem__, x)) for x in found]
        for m in long:
            del self.known[m]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


class Decoder:
    """Bytes of ids: the tokens' bytes lie one after the other in one array, from which all ids of a batch are read at once."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = sorted((r, t) for t, r in ranks.items())
        self.sizes = np.zeros(by_id[-1][0] + 1, np.int64)
        self.sizes[[r for r, _ in by_id]] = [len(t) for _, t in by_id]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)

    def decode_all(self, many: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(many), "<u4")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *[len(x) // 4 for x in many]])].tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(key: tuple, ranks) -> Encoder:
    """One for all the tasks of a Python worker."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks(), key[1])
    return _ENCODERS[key]


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and ``out``: binary, the ids of each whole text as little-endian unsigned 32-bit integers.

    A column named ``out`` is replaced.

    Null counts as empty and gives no ids. A few hundred rows are held besides their Arrow batch; nothing is shuffled. Strings of
    special tokens are ordinary text. Very long texts and very long matches are encoded whole.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).withColumn(out, F.lit(b""))
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: fixed size
    key = (hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, lambda: shared.value)
        for batch in slices(batches, 256):
            ids = pa.array(encoder.encode_all(texts(batch.column(text))), pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], ids], [*kept, out])

    return df.mapInArrow(run, schema.schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: binary, the bytes that the ids of each row stand for; null counts as no ids. Replaces a column of that name."""
    kept = [c for c in df.columns if c != out]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).withColumn(out, F.lit(b""))
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in slices(batches, 64):
            found = decoder.decode_all([x or b"" for x in batch.column(ids).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.binary())], [*kept, out])

    return df.mapInArrow(run, schema.schema)


def op2(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    ranks = load_ranks(docs.sparkSession, path)
    coded = decode(encode(docs, ranks, pattern, keep=["doc_id"]), ranks)
    return coded.select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
