"""Connected components by large-star and small-star steps, as joins and minima: no neighbourhood is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, joined_on

#: Steps after which a graph that still changes is an error; each step about halves the distances to the least node.
MOST_STEPS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is the least node that can be reached.

    Links of a node to itself count for nothing, nor do nulls. Repeated links count once. A hub's links are joined to its one
    minimum by a broadcast of hubs, of which there is a bounded number. Each step is written, so a lost executor costs the step it was in.
    """
    scratch = Scratch(links.sparkSession)
    edges = links.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.written(edges)
    state = _state(edges)
    for _ in range(MOST_STEPS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = joined_on(both.filter("v > u"), least, ["u"], 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = scratch.written(large)
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = joined_on(large, down, ["u"], 2 * state[0])
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, edges = edges, scratch.written(small.filter("u != v").distinct())
        scratch.drop(before, large)
        new = _state(edges)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
