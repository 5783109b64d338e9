"""Variable-capacity best-fit packing of sequences into bins of several permitted lengths."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import parallelism

CAPACITIES = (2048, 4096, 8192, 16384)
#: What a bin costs besides its length; makes few long bins cheaper than many short ones.
OVERHEAD = 64
#: Rows packed together. Only the last few bins of a group are left part-empty.
GROUP_ROWS = 20_000


class Lengths:
    """Sorted lengths still to be packed, with look-ahead: what a bin could be filled with."""

    def __init__(self, falling: Sequence[int]):
        self.values = sorted(set(falling))
        self.counts = Counter(falling)

    def take(self, n: int) -> None:
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.values[bisect_left(self.values, n)]

    def filled(self, room: int, most: int = 64) -> int:
        """How much of ``room`` the longest lengths that fit, one after the other, would take up."""
        at, left = len(self.values), room
        for _ in range(most):
            at = bisect_right(self.values, left, 0, at)
            if not at:
                break
            n = self.values[at - 1]
            left -= n * min(self.counts[n], left // n)
            at -= 1
        return room - left


def least_cost(length: int, left: Lengths, costs: Mapping[int, float]) -> int:
    """The capacity to open for ``length`` while ``left`` is still to be packed: that of least cost for each unit it would hold."""
    return min((c for c in costs if c >= length), key=lambda c: (costs[c] / (length + left.filled(c - length)), c))


def _packed(lengths: Sequence[int], costs: Mapping[int, float], least: int | None) -> tuple[float, list[int], list[int], list[int]]:
    rooms: list[int] = []  # the different amounts of room, sorted
    open_bins: dict[int, list[int]] = {}
    used: list[int] = []
    bins, offsets, left = [], [], Lengths(lengths) if least is None else None
    for n in lengths:
        if left:
            left.take(n)
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            k = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
        else:
            k, room = len(used), least_cost(n, left, costs) if left else min(c for c in costs if c >= max(n, least))
            used.append(0)
        bins.append(k)
        offsets.append(used[k])
        used[k] += n
        if room := room - n:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append(k)
    capacities = [min((c for c in costs if c >= u), key=lambda c: (costs[c], c)) for u in used]
    return sum(map(costs.__getitem__, capacities)), bins, offsets, capacities


def best_fit(lengths: Sequence[int], costs: Mapping[int, float]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length, and the capacity of each bin. Lengths: 1 to the largest capacity, in falling order.

    Each goes to the open bin that it leaves the least room in, of equals to the one opened last; where none fits, the
    bin size of least cost for what it would hold of the lengths still left is opened. The same is tried with the bins that
    are opened held to each least capacity in turn, so that all permitted lengths are weighed against each other on these
    lengths. Each bin shrinks to the cheapest capacity that holds its contents, and the packing of least cost is taken.
    """
    return min((_packed(lengths, costs, least) for least in (None, *sorted(costs))), key=lambda p: p[0])[1:]


def _pack_groups(costs: dict[int, float], id_type: pa.DataType):
    largest = max(costs)
    schema = pa.schema([("doc_id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("bin_id", pa.int64()), ("bin_offset", pa.int32()), ("capacity", pa.int32())])

    def packed(group: int, before: int, rows: pa.Table) -> tuple[pa.RecordBatch, int]:
        """Packs rows of a group of which ``before`` bins are already full; with them how many bins there are then."""
        lengths = rows.column("length").to_numpy()
        pieces = np.maximum(1, -(-lengths // largest))
        row = np.repeat(np.arange(len(lengths)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(largest, lengths[row] - piece * largest)
        order = np.argsort(-size, kind="stable")
        row, piece, size = row[order], piece[order], size[order]
        bins, offsets, capacities = best_fit(size.tolist(), costs)
        bins = np.array(bins, np.int64)
        ids = (np.int64(group) << np.int64(36)) + before + bins
        batch = pa.record_batch([rows.column("doc_id").combine_chunks().take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * largest, pa.int64()), pa.array(size, pa.int32()), pa.array(ids), pa.array(offsets, pa.int32()), pa.array(np.array(capacities, np.int32)[bins])], schema=schema)
        return batch, before + len(capacities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by group. A group of over GROUP_ROWS * 2 rows, as of a repeated id, is packed in parts."""
        held: list[pa.RecordBatch] = []
        group, before, count = None, 0, 0

        for batch in batches:
            groups = batch.column("_group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and (groups[a] != group or count + b - a > 2 * GROUP_ROWS):
                    batch_out, before = packed(group, before, pa.Table.from_batches(held))
                    yield batch_out
                    before = before if groups[a] == group else 0
                    held, count = [], 0
                group = int(groups[a])
                held.append(batch.slice(a, b - a))
                count += b - a
        if held:
            yield packed(group, before, pa.Table.from_batches(held))[0]

    return run


def pack(df: DataFrame, length: Column, id_col: str = "doc_id", capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, spread: Column | None = None) -> DataFrame:
    """Packs rows of ``length`` units into bins: doc_id, piece, start, length, bin_id, bin_offset, capacity.

    A row longer than the largest capacity is cut into pieces of that capacity and a rest; ``start`` is a piece's place in
    its row. Rows are dealt into groups of about GROUP_ROWS by a hash of id, length and ``spread``, which tells rows of one id
    apart, and each group is packed by itself by ``best_fit``, so the result doesn't depend on partitions. Only id and length are shuffled.
    Rows that agree in all three are one group, packed in parts as they stream by. Ids may have any type.
    Null or negative lengths count as 0, and a length of 0 still takes one unit. Null ids and repeated rows are packed like
    others. An empty table gives an empty table. Other columns of ``df``, whatever their names, play no part.
    """
    spark, costs = df.sparkSession, {int(c): c + overhead for c in sorted(capacities)}
    slim = df.select(F.col(id_col).alias("doc_id"), (F.lit(None).cast("long") if spread is None else spread).alias("_spread"), F.greatest(F.lit(1), F.coalesce(length, F.lit(0))).cast("long").alias("length"))
    groups = max(1, math.ceil(df.count() / GROUP_ROWS))
    dealt = slim.withColumn("_group", F.pmod(F.xxhash64("doc_id", "length", "_spread"), F.lit(groups)).cast("long")).drop("_spread")
    dealt = dealt.repartition(max(1, min(groups, 8 * parallelism(spark))), "_group").sortWithinPartitions("_group", F.desc("length"), "doc_id")
    kind = slim.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length int, bin_id long, bin_offset int, capacity int"
    return dealt.mapInArrow(_pack_groups(costs, to_arrow_type(kind)), schema)


def byte_length(text: Column) -> Column:
    """Tokens of a byte-level model: UTF-8 bytes and one end mark."""
    return F.octet_length(F.coalesce(text, F.lit(""))) + 1


def op1(docs: DataFrame) -> DataFrame:
    return pack(docs, byte_length(F.col("text")), spread=F.xxhash64("text"))
