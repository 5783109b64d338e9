"""Which numbers lie in which ranges, as an equality join: for axes inside documents of any size.

A range is looked for at one scale only, that on which it covers a few blocks of 2**k numbers; a number lies in one block of each scale. Blocks are the second key
of the join, so a document is spread over as many tasks as it has blocks, and no block is larger than the largest scale: a range over a million numbers is some
five hundred rows, each of which meets two thousand numbers at most. Every number is shuffled once a scale, so there are two: of ranges that don't lie in each other a number meets
16 in vain at most on either, which costs less than another row of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of blocks as powers of two. A range goes to the first scale on which it is no longer than FEW blocks; to the last if it is longer on all.
SCALES, FEW = (4, 11), 8


def _scale(length: Column) -> Column:
    return reduce(lambda other, k: F.when(length <= FEW << k, k).otherwise(other), reversed(SCALES[:-1]), F.lit(SCALES[-1]))


def ranges(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """``df`` with ``_scale`` and ``_block``, a row for each block that its range, ends included, touches; none for an empty range."""
    held = df.withColumns({"_first": first.cast("long"), "_last": last.cast("long")}).filter("_first <= _last")
    scaled = held.withColumn("_scale", _scale(F.col("_last") - F.col("_first") + 1))
    blocks = F.sequence(F.expr("shiftright(_first, _scale)"), F.expr("shiftright(_last, _scale)"))
    return scaled.withColumn("_block", F.explode(blocks))


def numbers(df: DataFrame, at: Column) -> DataFrame:
    """``df`` with ``_at`` and, a row for each scale, ``_scale`` and ``_block``."""
    held = df.withColumn("_at", at.cast("long")).withColumn("_scale", F.explode(F.array(*map(F.lit, SCALES))))
    return held.withColumn("_block", F.expr("shiftright(_at, _scale)"))


def pairs(points: DataFrame, at: Column, spans: DataFrame, first: Column, last: Column, keys: list[str]) -> DataFrame:
    """Each row of ``points`` with each row of ``spans`` that has the same ``keys`` and a range around the point's number, once.

    Apart from the keys, the two may have no column name in common.
    """
    joined = numbers(points, at).join(ranges(spans, first, last), [*keys, "_scale", "_block"])
    return joined.filter("_at between _first and _last").drop("_scale", "_block", "_at", "_first", "_last")
