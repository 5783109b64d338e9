"""document() as a join: values of one table of nodes looked up in another, however many documents each has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import xpath as X
from .xpath_frames import Frames, select, string_values

#: Keys of the table looked up in are broadcast up to so many, and to so many bytes, both counted first.
KEYS, BYTES = 200_000, 16 << 20


def keyed(nodes: DataFrame, rows: str, key: str, value: str) -> DataFrame:
    """(key, value): for each key, the string value of ``value`` at the first node, in the order of documents and in them, of those that ``rows`` gives with that ``key``.

    ``key`` and ``value`` are paths from such a node; one without a key isn't found, a missing value is an empty string. Keys are aggregated before they are shuffled, so a
    key of a third of all nodes is one row a task.
    """
    frames = Frames(nodes)
    found = select(nodes, rows)
    found, k = frames._string(X.parse(key), found)
    found = found.withColumn("key", k)
    found, v = frames._string(X.parse(value), found)
    found, has = frames.value(X.parse(key), found)
    held = found.filter(has.as_("bool")).select("key", v.alias("value"), F.struct("doc_id", "pre").alias("at"))
    return held.groupBy("key").agg(F.min_by("value", "at").alias("value"))


def lookup(nodes: DataFrame, path: str, other: DataFrame, rows: str, key: str, value: str) -> DataFrame:
    """(doc_id, pre, key, value): of each node that ``path`` gives, its string value and what that finds in ``other`` (see ``keyed``); null where it finds nothing.

    What is looked up in is broadcast if its keys, counted first, are few; else both are shuffled by key. Both tables should be stored ones.
    """
    asked = string_values(select(nodes, path), nodes).select("doc_id", "pre", F.col("text").alias("key"))
    facts = keyed(other, rows, key, value)
    size = facts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("value")), F.lit(0)).alias("bytes")).first()
    small = size.n <= KEYS and size.bytes <= BYTES
    return asked.join(F.broadcast(facts) if small else facts.hint("shuffle_merge"), "key", "left").select("doc_id", "pre", "key", "value")
