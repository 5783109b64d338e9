"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, as DataFrame operations only.

A text is cut into paragraphs (lines, and in them sentences); its set of paragraph digests goes into a sketch of CELLS cells,
each digest into one cell of each third. A cell holds the number of its digests and the exclusive ors of the digests and of
their checks. Two sketches subtract cell by cell, which leaves what differs; cells that hold a single digest give it up, it
is taken from its other cells, and so on until all is empty. If that fails, the digests are dealt by their hash to blocks of
about BLOCK digests with a sketch each, and a block that still fails gets three times as many cells, twice. What even then
doesn't peel, as digests that meet in all their cells, is compared as a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, written

#: Cells of a fingerprint; of a block's sketches, tried in turn; digests that a block holds on average.
CELLS, TRIES, BLOCK = 24, (36, 108, 324), 16
#: Rounds of peeling; a sketch that isn't empty by then counts as failed.
ROUNDS = 12
_NULL_ID = -(1 << 63)


def digests(text: str) -> str:
    """SQL: the distinct digests of a text's paragraphs; blank ones don't count."""
    return f"array_distinct(transform(filter(split({text}, '[\\\\n\\\\r]+|(?<=[.!?]) +'), p -> trim(p) != ''), p -> xxhash64(p)))"


def _spread(x: str, n: str, cells: int) -> str:
    """SQL struct of a digest, its number, its cell in each third and its check."""
    w = cells // 3
    return f"named_struct('k', {x}, 'n', {n}, 'a', cast(pmod(xxhash64({x}, 1), {w}) as int), 'b', cast(pmod(xxhash64({x}, 2), {w}) as int), 'c', cast(pmod(xxhash64({x}, 3), {w}) as int), 'h', xxhash64({x}, 9) & 4294967295)"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def sketch(found: str, cells: int = CELLS) -> str:
    """SQL: the cells of a set of digests, third by third."""
    held = f"transform({found}, x -> {_spread('x', '1', cells)})"
    third = "transform(sequence(0, {last}), j -> aggregate(filter(u, q -> q.{f} = j), named_struct('n', 0, 'k', 0L, 'h', 0L), (z, q) -> named_struct('n', z.n + q.n, 'k', z.k ^ q.k, 'h', z.h ^ q.h)))"
    return _let(held, "u", "concat(" + ", ".join(third.format(last=cells // 3 - 1, f=f) for f in "abc") + ")")


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def peel(cells: str, count: int) -> str:
    """SQL: the digests in a difference, as structs of k and n (1: only in the first, -1: only in the second); null on failure."""
    w = count // 3
    pure = f"array_distinct(transform(filter(s.t, c -> abs(c.n) = 1 and c.h = (xxhash64(c.k, 9) & 4294967295)), c -> {_spread('c.k', 'c.n', count)}))"
    third = "transform(slice(s.t, {at}, {w}), (c, j) -> aggregate(filter(p, q -> q.{f} = j), c, (z, q) -> named_struct('n', z.n - q.n, 'k', z.k ^ q.k, 'h', z.h ^ q.h)))"
    less = "concat(" + ", ".join(third.format(at=1 + k * w, w=w, f=f) for k, f in enumerate("abc")) + ")"
    after = f"named_struct('t', {less}, 'd', concat(s.d, transform(p, q -> named_struct('k', q.k, 'n', q.n))))"
    start = f"named_struct('t', {cells}, 'd', cast(array() as array<struct<k:bigint,n:int>>))"
    step = _let(pure, "p", f"if(size(p) = 0, s, {after})")
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> {step}, s -> if(forall(s.t, c -> c.n = 0 and c.k = 0 and c.h = 0), s.d, null))"


def _blocks(found: str, low: str, high: str) -> str:
    """SQL: digests dealt to ``low`` * ``high`` blocks, by the first and then within each by the second."""
    inner = _let(f"filter({found}, x -> (x & 9223372036854775807) % {low} = f)", "v", f"transform(sequence(0L, {high} - 1L), g -> filter(v, x -> ((x & 9223372036854775807) div {low}) % {high} = g))")
    return f"flatten(transform(sequence(0L, {low} - 1L), f -> {inner}))"


def differing(a: str, b: str, cells_a: str | None = None, cells_b: str | None = None) -> str:
    """SQL: the digests that are in one set only, by the sketches; ``a`` and ``b`` are columns of digests, the others of their sketches."""
    first = peel(subtract(cells_a or sketch(a), cells_b or sketch(b)), CELLS)
    tries = ", ".join(peel(subtract(sketch("p", n), sketch("q", n)), n) for n in TRIES)
    every = "concat(transform(array_except(p, q), x -> named_struct('k', x, 'n', 1)), transform(array_except(q, p), x -> named_struct('k', x, 'n', -1)))"
    # a power of two of blocks, dealt in two steps of about equal numbers
    power = f"cast(ceil(log2(greatest(1, (size({a}) + size({b})) / {BLOCK}.0))) as int)"
    larger = _let(power, "e", _let("named_struct('l', shiftleft(1L, cast(e div 2 as int)), 'h', shiftleft(1L, cast(e - e div 2 as int)))", "w", f"flatten(zip_with({_blocks(a, 'w.l', 'w.h')}, {_blocks(b, 'w.l', 'w.h')}, (p, q) -> coalesce({tries}, {every})))"))
    # sets whose sizes lie further apart than there are cells can't be peeled
    return f"coalesce(if(abs(size({a}) - size({b})) <= {CELLS}, {first}, null), {larger})"


def likeness(a: str, b: str, difference: str) -> Column:
    """Share of digests in common, from the sizes of two sets and of their difference; 1 for two empty sets."""
    return F.expr(f"if(size({a}) + size({b}) = 0, 1D, (size({a}) + size({b}) - size({difference})) / cast(size({a}) + size({b}) + size({difference}) as double))")


def fingerprint(found: str, cells: str) -> Column:
    """A sketch as a string: the number of digests and each cell's number, digests and checks."""
    return F.expr(f"concat(size({found}), ':', array_join(transform({cells}, c -> concat_ws('.', c.n, lower(hex(c.k)), lower(hex(c.h)))), ','))")


def predecessors(ids: DataFrame) -> DataFrame:
    """Adds prev_k, prev_h, prev_n to distinct rows (k, h, n): the row before in order of k, h; of the first, the last row.

    The rows, without texts, are dealt out by range and written, so that the parts stay the same; a row a part is gathered
    to join them up.
    """
    parts = 4 * parallelism(ids.sparkSession)
    dealt = written(ids.repartitionByRange(parts, "k", "h").withColumn("part", F.spark_partition_id()))
    row = F.struct("k", "h", "n")
    ends = dealt.groupBy("part").agg(F.max(row).alias("end"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ends.select("part", F.coalesce(F.lag("end").over(Window.orderBy("part")), F.last("end").over(whole)).alias("end"))
    inside = dealt.withColumn("prev", F.lag(row).over(Window.partitionBy("part").orderBy("k", "h")))
    joined = inside.join(F.broadcast(before), "part").withColumn("prev", F.coalesce("prev", "end"))  # a row a part
    return joined.select("k", "h", F.col("prev.k").alias("prev_k"), F.col("prev.h").alias("prev_h"), F.col("prev.n").alias("prev_n"))


def op4(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness to each other and to the next document's.

    Documents follow each other by doc_id, nulls first, those of one id by a hash of the text; rows repeated whole are one
    document in that order and each get its result. Null texts are empty; a sketch of no paragraphs is all zeros.
    Texts are shuffled once, and once more by halves to the document before.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    texts = texts.select("k", F.xxhash64("t").alias("h"), "t")
    ids = texts.select("k", "h", F.char_length("t").alias("n")).distinct()
    order = predecessors(ids)
    sent = (
        texts.join(order, ["k", "h"])
        .select(F.col("prev_k").alias("k"), F.col("prev_h").alias("h"), F.expr("substring(t, 1, prev_n div 2)").alias("head"), F.expr(digests("t")).alias("next_u"))
        .dropDuplicates(["k", "h"])
    )
    both = texts.join(sent, ["k", "h"]).withColumn("n", F.char_length("t"))
    edited = both.withColumn("e", F.expr("concat(substring(t, 1, n - n div 2), head)"))
    units = edited.select("k", "n", F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), F.expr(digests("t")).alias("u"), F.expr(digests("e")).alias("e_u"), "next_u")
    sketched = units.withColumns({"u_s": F.expr(sketch("u")), "e_s": F.expr(sketch("e_u")), "n_s": F.expr(sketch("next_u"))})
    sketched = sketched.withColumns({"e_d": F.expr(differing("u", "e_u", "u_s", "e_s")), "n_d": F.expr(differing("u", "next_u", "u_s", "n_s"))})
    return sketched.select(
        F.when(F.col("k") != F.lit(_NULL_ID), F.col("k")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"), "edited_sha256",
        fingerprint("u", "u_s").alias("fingerprint"), fingerprint("e_u", "e_s").alias("edited_fingerprint"),
        likeness("u", "e_u", "e_d").alias("near_edited"), likeness("u", "next_u", "n_d").alias("near_next"),
        F.size("e_d").alias("differing_edited"), F.size("n_d").alias("differing_next"),
    )
