"""Near-duplicate documents: a chosen-path set similarity join over minwise tokens of word shingles.

1. Each text becomes a set of hashed 5-word shingles. Texts with the same set are one node, named by 64 bits of the set's
   digest, with TOKENS minwise tokens to estimate likeness by.
2. Independent trees branch the nodes: a tree node picks one or two minwise functions (a third more than one on average, the
   inverse of the similarity) and sends each of its documents to a child for the token that it has there.
3. Tree nodes of LEAF documents at most are leaves. Larger ones are first cut at random into small parts. A forest of likely
   pairs in each leaf and part is confirmed on the full sets, which gives components.
4. A large tree node whose documents now belong to one component needs no more work. Where each document has few partners of
   other components, all of them are compared, block against block; otherwise the node branches on. A node of HELD documents
   at most does all this in one task, a larger one level by level over the whole cluster.
5. In leaves and blocks with several components all likely pairs across components are compared on their full sets, and
   links that join components are kept.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, joined_on, parallelism, slices
from .components import components

SHINGLE = 5
#: Minwise tokens of a document, of a byte each.
TOKENS = 256
#: A pair at the threshold meets in one tree with a probability over 0.75 where one level is enough; with so many trees it
#: is missed about once in a million, and about once in a hundred where four levels are needed.
TREES = 10
#: Documents of a leaf, and levels below the root; what is still large at the last one is compared in blocks.
LEAF, LEVELS = 64, 8
#: Documents of a block, and the partners of other components for each document of a tree node up to which blocks are compared.
BLOCK, PARTNERS = 256, 512
#: Documents of a tree node that may branch on in one task; their tokens are a megabyte.
HELD = 4096
#: Share of equal tokens from which a pair is compared on full sets: over four standard deviations below 0.75.
LIKELY = 0.63
#: The same for the forest that is tried first.
PROMISING = 0.7
#: Names of rows, of four numbers each, that may be broadcast.
BROADCAST_ROWS = 500_000
NUMERATOR, DENOMINATOR = 75, 100
_RNG = np.random.default_rng(20240613)
_A = _RNG.integers(1, 1 << 32, TOKENS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, TOKENS, dtype=np.uint32)
_POSITION = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SEEN = "doc_id long, tag long, n_shingles long, id long, tokens binary, keys array<bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, words: Words) -> np.ndarray:
    """The set of a text's hashed shingles, sorted. Words are of A-Z in lower case, parted by ASCII white space."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(words.__getitem__, found)), np.uint64)
    n = len(h) - SHINGLE + 1
    if n < 1:
        return _mix(np.array([(h * _POSITION[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    total = h[:n] * _POSITION[0]
    for k in range(1, SHINGLE):
        total += h[k : n + k] * _POSITION[k]
    return np.unique(_mix(total))


def minwise(found: np.ndarray) -> np.ndarray:
    """TOKENS minwise tokens of a set that isn't empty, a byte each."""
    least = np.full(TOKENS, np.iinfo(np.uint32).max, np.uint32)
    small = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(small), 256):
        part = small[at : at + 256, None] * _A + _B
        np.minimum(least, part.min(axis=0), out=least)
    return (_mix(least.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)


def root_functions(trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and salts of the minwise functions, of 64 bits, by which the roots branch: one a tree, in every third tree two."""
    rng = np.random.default_rng(20240617)
    n = sum(2 if t % 3 == 0 else 1 for t in range(trees))
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(1, 1 << 63, n, dtype=np.uint64)


def _profiled(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (a, b) = Words(), root_functions(trees)
        for batch in slices(batches):
            sizes, ids, tokens, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, words)
                sizes.append(len(found))
                if len(found):
                    ids.append(int.from_bytes(xxhash.xxh3_128_digest(found.tobytes())[:8], "little", signed=True))
                    tokens.append(minwise(found).tobytes())
                    least = np.array([(found * x).min() for x in a])
                    keys.append(_mix(least ^ b).astype(np.int64))
                else:
                    ids.append(None), tokens.append(None), keys.append(None)
            columns = [pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(tokens, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), *columns], ["doc_id", "tag", "n_shingles", "id", "tokens", "keys"])

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingles(t, words).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["id", "full"])


def full_sets(scratch: Scratch, rows: DataFrame, one: DataFrame) -> DataFrame:
    """(id, full), written: the full set of each node in ``one`` (id, doc_id, tag, copies), which names a row of its text in ``rows`` (doc_id, tag, text).

    Up to BROADCAST_ROWS of them are broadcast, so that no text is shuffled; beyond, it is a shuffled join, for which Spark drops
    most other rows by a Bloom filter before the shuffle. Only rows that are repeated whole under one id give a set many times.
    """
    one = scratch.written(one)
    named = F.broadcast(one) if one.count() <= BROADCAST_ROWS else one.filter("copies > 0")
    found = rows.join(named, ["doc_id", "tag"]).select("id", "text").mapInArrow(_full_sets, "id long, full binary")
    return scratch.written(found if one.filter("copies > 1").isEmpty() else found.dropDuplicates(["id"]))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have the similarity."""
    if NUMERATOR * max(len(x), len(y)) > DENOMINATOR * min(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        x, y = ([np.frombuffer(s, np.uint64) for s in batch.column(c).to_pylist()] for c in ("full_a", "full_b"))
        keep = pa.array(list(map(alike, x, y)), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)


def confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b), those whose full sets have the similarity; ``full``: (id, full), each id once."""
    left = pairs.join(full.select(F.col("id").alias("a"), F.col("full").alias("full_a")), "a")
    both = left.join(full.select(F.col("id").alias("b"), F.col("full").alias("full_b")), "b")
    return both.select("a", "b", "full_a", "full_b").mapInArrow(_confirm, "a long, b long")


def _children(node: str) -> str:
    """SQL array of the child nodes of ``node`` for a document with ``tokens``: one, or for a third of the nodes two."""
    child = f"xxhash64({node}, c, substring(tokens, c + 1, 1))"
    pick = f"pmod(xxhash64({node}, {{}}), {TOKENS})"
    return f"transform(array_distinct(if(pmod(xxhash64({node}, 7), 3) = 0, array({pick.format(1)}, {pick.format(2)}), array({pick.format(1)}))), c -> {child})"


def _sized(scratch: Scratch, at: DataFrame) -> DataFrame:
    """(node, id, n), written: the rows (node, id) whose node has n > 1 documents."""
    at = scratch.written(at)
    sizes = scratch.written(at.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"))
    out = scratch.written(joined_on(at, sizes, ["node"], at.count()))
    scratch.drop(at, sizes)
    return out


def _small(placed: DataFrame) -> DataFrame:
    return placed.filter(F.col("n") <= LEAF).select(F.col("node").alias("leaf"), "id")


def first_parts(placed: DataFrame) -> DataFrame:
    """(leaf, id): leaves, and random parts of about half a leaf of every third larger node; what they miss is left to ``across``."""
    salt = f"pmod(xxhash64(id, node, 'salt'), cast(ceil(n / {LEAF // 2}) as long))"
    cut = placed.filter(f"n > {LEAF} and pmod(xxhash64(node, 'cut'), 3) = 0").select(F.expr(f"xxhash64(node, 'part', {salt})").alias("leaf"), "id")
    return _small(placed).unionByName(cut)


def blocks(scratch: Scratch, large: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """(leaf, id, component, side) from ``large`` (node, id, component): a leaf for each pair of blocks of a node that can hold two components.

    A component of more than BLOCK documents of a node has blocks of its own, which aren't compared with each other; small
    components are dealt to common blocks whole. ``sizes``: (node, component, n); ``large`` has ``total`` rows.
    """
    rest = sizes.groupBy("node").agg(F.sum(F.when(F.col("n") <= BLOCK, F.col("n")).otherwise(0)).alias("rest"), F.sum("n").alias("n"))
    dealt = joined_on(large, sizes, ["node", "component"], total)
    dealt = joined_on(dealt.withColumnRenamed("n", "own"), rest, ["node"], total)
    own = f"own > {BLOCK}"
    place = f"if({own}, xxhash64(component, pmod(xxhash64(id, node), cast(ceil(own / {BLOCK}) as long))), pmod(xxhash64(component, node), cast(ceil(rest / {BLOCK}) as long)))"
    dealt = scratch.written(dealt.select("node", "id", "component", F.expr(place).alias("block"), F.expr(f"if({own}, component, null)").alias("alone")))
    each = scratch.written(dealt.groupBy("node", "block", "alone").agg(F.count("*").alias("n")))
    other = each.select("node", F.col("block").alias("other"), F.col("alone").alias("other_alone"))
    facing = each.select("node", "block", "alone").join(other, "node").filter("block <= other and not coalesce(alone = other_alone, false)")
    sides = "if(block = other, array(named_struct('block', block, 'side', 0)), array(named_struct('block', block, 'side', 1), named_struct('block', other, 'side', 2)))"
    facing = facing.select("node", F.expr("xxhash64(node, block, other, 'pair')").alias("leaf"), F.explode(F.expr(sides)).alias("b"))
    facing = facing.groupBy("node", F.col("b.block").alias("block")).agg(F.collect_list(F.struct("leaf", F.col("b.side").alias("side"))).alias("faced"))
    counted = facing.join(each.select("node", "block", "n"), ["node", "block"])
    return joined_on(dealt, counted, ["node", "block"], total).select("id", "component", F.explode("faced").alias("f")).select("f.leaf", "id", "component", "f.side")


def _labelled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))


def across(scratch: Scratch, nodes: DataFrame, placed: DataFrame, groups: DataFrame) -> DataFrame:
    """(leaf, id, component, side, level): leaves, blocks, and nodes to branch on in one task from ``level`` (null for others), in which documents of different components meet."""
    found: list[DataFrame] = []

    def meet(rows: DataFrame, side: str = "0", level: str = "null") -> None:
        found.append(rows.select("leaf", "id", "component", F.expr(f"int({side})").alias("side"), F.expr(f"int({level})").alias("level")))

    for level in range(LEVELS + 1):
        marked = _labelled(_small(placed), groups)
        mixed = marked.groupBy("leaf").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("leaf")
        meet(scratch.written(marked.join(mixed, "leaf")))
        large = scratch.written(_labelled(placed.filter(F.col("n") > LEAF).select("node", "id"), groups))
        total = large.count()
        if not total:
            break
        sizes = scratch.written(large.groupBy("node", "component").agg(F.count("*").alias("n")))
        partners = "(pow(sum(n), 2) - sum(n * n)) / sum(n)"
        work = sizes.groupBy("node").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.expr(partners).alias("partners")).filter("kinds > 1")
        way = f"if(n <= {HELD}, 'held', if({level == LEVELS} or partners <= {PARTNERS}, 'blocks', 'branches'))"
        work = scratch.written(work.select("node", "n", F.expr(way).alias("way")))
        ways = dict(work.groupBy("way").agg(F.sum("n")).collect())
        if not ways:
            break
        large = scratch.written(joined_on(large, work, ["node"], total).drop("n"))
        if "held" in ways:
            meet(large.filter("way = 'held'").withColumnRenamed("node", "leaf"), level=str(level))
        if "blocks" in ways:
            few = work.filter("way = 'blocks'").select("node")
            meet(scratch.written(blocks(scratch, large.filter("way = 'blocks'").drop("way"), sizes.join(few, "node", "left_semi"), ways["blocks"])), "side")
        if "branches" not in ways:
            break
        on = large.filter("way = 'branches'").select("id", "node").join(nodes.select("id", "tokens"), "id")
        placed = _sized(scratch, on.select("id", F.explode(F.expr(_children("node"))).alias("node")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Runs of equal ``leaf`` in batches sorted by it, as columns; runs of one row are left out."""
    held: list[pa.RecordBatch] = []
    key = None

    def columns() -> dict[str, list]:
        return pa.Table.from_batches(held).to_pydict()

    for batch in batches:
        keys = batch.column("leaf").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and keys[a] != key:
                if sum(h.num_rows for h in held) > 1:
                    yield columns()
                held = []
            key = keys[a]
            held.append(batch.slice(a, b - a))
    if sum(h.num_rows for h in held) > 1:
        yield columns()


def _likeness(tokens: list[bytes]) -> np.ndarray:
    """Share of equal tokens for each pair."""
    t = np.frombuffer(b"".join(tokens), np.uint8).reshape(len(tokens), TOKENS)
    return np.stack([(t == row).mean(axis=1, dtype=np.float32) for row in t])


def _root(parent: dict | list, i):
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(leaf: dict[str, list]) -> list[tuple[int, int]]:
    """Promising pairs that join a leaf's documents, the likeliest first."""
    ids, like, top = leaf["id"], _likeness(leaf["tokens"]), set()
    a, b = np.nonzero(np.triu(like >= PROMISING, 1))
    parent = list(range(len(ids)))
    for k in np.argsort(-like[a, b], kind="stable").tolist():
        i, j = _root(parent, int(a[k])), _root(parent, int(b[k]))
        if i != j:
            parent[max(i, j)] = min(i, j)
            top.add((int(a[k]), int(b[k])))
    return [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in top if ids[i] != ids[j]]


def candidates(leaf: dict[str, list]) -> list[tuple[int, int]]:
    """Places of all likely pairs across components, the likeliest first; a pair that shares small leaves belongs to the least of them only."""
    if len(set(leaf["component"])) < 2:
        return []
    group, side = np.array(leaf["component"]), np.array(leaf["side"])
    like = _likeness(leaf["tokens"])
    a, b = np.nonzero(np.triu((like >= LIKELY) & (group[:, None] != group) & ((side[:, None] != side) | (side == 0)), 1))
    own, small = leaf["leaf"][0], [set(s or ()) for s in leaf["small"]]
    order = np.argsort(-like[a, b], kind="stable")
    return [(i, j) for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True) if min(small[i] & small[j], default=own) == own]


def _named(node: int, *more: int) -> int:
    """A node below ``node``, of 64 bits."""
    return xxhash.xxh64_intdigest(struct.pack(f"<q{len(more)}q", node, *more)) - (1 << 63)


def branched(held: dict[str, list]) -> Iterator[dict[str, list]]:
    """Leaves and pairs of blocks of a node's documents, by the rules of ``across``."""
    tokens = np.frombuffer(b"".join(held["tokens"]), np.uint8).reshape(-1, TOKENS)
    group = np.array(held["component"])

    def meeting(leaf: int, at: np.ndarray, side: list[int]) -> dict[str, list]:
        return {c: [held[c][i] for i in at.tolist()] for c in ("id", "component", "tokens", "small")} | {"leaf": [leaf] * len(at), "side": side}

    todo = [(held["leaf"][0], np.argsort(group, kind="stable"), held["level"][0])]
    while todo:
        node, at, level = todo.pop()
        n, kinds = len(at), np.unique(group[at], return_counts=True)[1]
        if len(kinds) < 2:
            continue
        if n <= LEAF:
            yield meeting(node, at, [0] * n)
        elif level == LEVELS or (n * n - (kinds * kinds).sum()) / n <= PARTNERS:
            cut = [at[k : k + BLOCK] for k in range(0, n, BLOCK)]
            for i, x in enumerate(cut):
                yield meeting(_named(node, i, i), x, [0] * len(x))
                for j, y in enumerate(cut[i + 1 :], i + 1):
                    yield meeting(_named(node, i, j), np.concatenate([x, y]), [1] * len(x) + [2] * len(y))
        else:
            for c in {_named(node, k) % TOKENS for k in ((1, 2) if _named(node, 7) % 3 == 0 else (1,))}:
                order = at[np.argsort(tokens[at, c], kind="stable")]
                for part in np.split(order, np.flatnonzero(np.diff(tokens[order, c])) + 1):
                    todo.append((_named(node, c, int(tokens[part[0], c])), part, level + 1))


def _table(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for leaf in _grouped(batches):
        out += forest(leaf)
        if len(out) > 50_000:
            yield _table(out)
            out = []
    yield _table(out)


_MEETING = {"leaf": pa.int64(), "id": pa.int64(), "component": pa.int64(), "side": pa.int32(), "tokens": pa.binary(), "small": pa.list_(pa.int64())}
_HELD = (*_MEETING, "level")


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a leaf that take part in its candidates; nodes to branch on give their leaves and blocks first."""
    for leaf in (part for group in _grouped(batches) for part in ([group] if group["level"][0] is None else branched(group))):
        if wanted := sorted({i for pair in candidates(leaf) for i in pair}):
            yield pa.RecordBatch.from_arrays([pa.array([leaf[c][i] for i in wanted], t) for c, t in _MEETING.items()], list(_MEETING))


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that are alike on their full sets; of a leaf, only those that join components."""
    for leaf in _grouped(batches):
        parent = {c: c for c in leaf["component"]}
        full = [np.frombuffer(s, np.uint64) for s in leaf["full"]]
        out = []
        for i, j in candidates(leaf):
            x, y = _root(parent, leaf["component"][i]), _root(parent, leaf["component"][j])
            if x != y and alike(full[i], full[j]):
                parent[max(x, y)] = min(x, y)
                out.append((leaf["id"][i], leaf["id"][j]))
        if out:
            yield _table(out)


def _leafwise(members: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the rows of each leaf; leaves are small, so any partition of them is even."""
    n = 2 * parallelism(members.sparkSession)
    return members.repartition(n, "leaf").sortWithinPartitions("leaf", "id").mapInArrow(run, schema)


def classes(df: DataFrame, text: str = "text", id_col: str = "doc_id", trees: int = TREES) -> DataFrame:
    """(doc_id, tag, n_shingles, id, label), written: a row for each row of ``df``, with its node and its component's node.

    tag is xxhash64 of the text; id is null for rows without words or doc_id, label null too.
    """
    scratch = Scratch(df.sparkSession)
    written = scratch.written
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tag", F.xxhash64("text"))
    profile = written(rows.mapInArrow(_profiled(trees), _SEEN).withColumn("id", F.expr("if(doc_id is null, null, id)")))
    nodes = written(profile.filter("id is not null").select("id", "tokens", "keys").dropDuplicates(["id"]))
    placed = _sized(scratch, nodes.select("id", F.explode("keys").alias("node")))
    small = written(_small(placed).groupBy("id").agg(F.collect_list("leaf").alias("small")))
    rows_of = profile.filter("id is not null").groupBy("id", "doc_id", "tag").agg(F.count("*").alias("copies"))
    one = rows_of.groupBy("id").agg(F.min(F.struct("doc_id", "tag", "copies")).alias("r")).join(placed.select("id").distinct(), "id")
    one = written(one.select("id", "r.*"))
    parts = first_parts(placed).join(nodes.select("id", "tokens"), "id")
    first = written(_leafwise(parts, _forests, "a long, b long").distinct())
    tried = written(first.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    full = full_sets(scratch, rows, one.join(tried, "id"))
    groups = written(components(confirmed(first, full)).select(F.col("node").alias("id"), "component"))
    meeting = across(scratch, nodes, placed, groups).join(nodes.select("id", "tokens"), "id").join(small, "id", "left")
    close = written(_leafwise(meeting.select(*_HELD), _promising, "leaf long, id long, component long, side int, tokens binary, small array<bigint>"))
    left = close.select("id").distinct().join(tried, "id", "left_anti")
    full = full.unionByName(full_sets(scratch, rows, one.join(left, "id")))
    more = _leafwise(close.join(full, "id"), _joining, "a long, b long").distinct()
    # what the first links join is joined by a link from each to its least
    stars = groups.select(F.col("id").alias("a"), F.col("component").alias("b"))
    found = components(stars.unionByName(written(more))).select(F.col("node").alias("id"), F.col("component").alias("label"))
    seen = profile.drop("tokens", "keys")
    out = written(seen.join(found, "id", "left").withColumn("label", F.coalesce("label", "id")))
    scratch.drop(*[t for t in scratch.tables if t is not out])
    return out


def link(df: DataFrame, text: str = "text", id_col: str = "doc_id", trees: int = TREES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``df``.

    component_id: the least doc_id that can be reached over links; kept: doc_id is component_id. Null, empty and blank texts
    have no shingles and are linked with nothing. Rows that share a doc_id are told apart by their texts, and each has the
    component of its own text. A row of null doc_id is linked with nothing and kept, its component null. Very long texts are
    read whole; of groups of copies one row goes on after a partial aggregation. Other columns of ``df`` play no part. Texts
    are one node by 64 bits of a digest of their shingles, so among a billion different texts two are taken for one with a probability of 0.03.
    """
    rows = classes(df, text, id_col, trees)
    found = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    with_label, without = rows.filter("label is not null"), rows.filter("label is null")
    joined = joined_on(with_label, found, ["label"], with_label.count()).select("doc_id", "n_shingles", "component_id")
    out = joined.unionByName(without.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def representatives(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (doc_id, text and others) that stay: of each component the one of least doc_id, and all without words or doc_id.

    Of rows with that doc_id in the component, that of the least hash of the text stays, and one of rows that are repeated.
    """
    rows = classes(df).filter("label is not null")
    one = rows.groupBy("label", "doc_id", "tag").agg(F.count("*").alias("copies")).groupBy("label").agg(F.min(F.struct("doc_id", "tag", "copies")).alias("r"))
    one = one.select(F.col("r.doc_id").alias("doc_id"), F.col("r.tag").alias("_tag"), F.col("r.copies").alias("_copies"))
    blank = F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    named = df.filter(~blank).withColumn("_tag", F.xxhash64("text")).join(one, ["doc_id", "_tag"])
    single, repeated = named.filter("_copies = 1"), named.filter("_copies > 1").dropDuplicates(["doc_id", "_tag"])
    return single.unionByName(repeated).select(*df.columns).unionByName(df.filter(blank))


def op3(docs: DataFrame) -> DataFrame:
    return link(docs)
