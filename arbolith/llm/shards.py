"""Sharding by a Feistel permutation of global row numbers, as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets in which rows are numbered, by default. Their counts are all that is gathered, so it is bounded by this number; a
#: bucket is sorted with spilling, so ten thousand million rows, five million a bucket, are still fine.
BUCKETS = 2048
#: Feistel rounds, and the most walks along a cycle. An out-of-range value is met at most once on a cycle and there are
#: fewer than sqrt(n) of them, so for n up to 4096 this many walks always suffice; beyond, 64 misses in a row have a
#: probability under n ** -32.
ROUNDS, WALKS = 6, 64


def number_rows(df: DataFrame, key: list[str], order: list[str], name: str = "row_number", buckets: int = BUCKETS) -> DataFrame:
    """Adds ``name``: gapless global row numbers from 0, and ``n_rows``, the number of rows.

    Rows are numbered in hashed buckets of ``key``, in ``order`` within a bucket. The numbers depend on the rows alone, not
    on partitions or retries. Only one count a bucket is gathered. Equal rows get different numbers; null keys count as a value.
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"),
    )
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return (
        bucketed.withColumn("_within", within)
        .join(F.broadcast(starts), "_bucket")  # BUCKETS rows at most
        .withColumn(name, F.col("_start") + F.col("_within"))
        .drop("_bucket", "_within", "_start")
    )


def _rounds(x: str, seed: int) -> str:
    """SQL of a Feistel network over [0, _a * _b): halves below _a and _b, which change places every round."""
    halves = f"named_struct('l', {x} % _a, 'r', {x} div _a)"
    for i in range(ROUNDS):
        m = "_a" if i % 2 == 0 else "_b"
        halves = f"transform(array({halves}), q -> named_struct('l', q.r, 'r', (q.l + pmod(xxhash64(q.r, {seed + i}L), {m})) % {m}))[0]"
    return f"transform(array({halves}), q -> q.l + q.r * _a)[0]"


def permuted(number: str, n_rows: str, seed: int) -> Column:
    """Where row ``number`` of ``n_rows`` goes: a permutation of 0 .. n_rows - 1. A walk that isn't over after WALKS steps is an error."""
    over = f"if(x < {n_rows}, x, cast(raise_error('a walk along a cycle did not end') as bigint))"
    return F.expr(f"aggregate(sequence(1, {WALKS}), {_rounds(number, seed)}, (x, i) -> if(x < {n_rows}, x, {_rounds('x', seed)}), x -> {over})")


def assign(df: DataFrame, shards: int = 8, seed: int = 20240229, key: list[str] | None = None, order: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``shard`` (0 .. shards - 1) and ``slot`` (gapless from 0 in each shard) to every row; shard sizes differ by one row at most.

    The global row number goes through a Feistel network over a domain a * b, the least with a = ceil(sqrt(n)), and walks
    its cycle until it is below n. Shard and slot are remainder and quotient of the result, so both can be computed for any
    row number without looking at other rows. An empty table gives an empty table. Null keys and repeated rows are placed as
    any other row. Columns of ``df`` named shard, slot, row_number or n_rows are replaced.
    """
    key = key or ["doc_id"]
    df = df.drop("shard", "slot", "row_number", "n_rows")
    n = number_rows(df, key, order or key, buckets=buckets)
    sized = n.withColumn("_a", F.ceil(F.sqrt(F.col("n_rows").cast("double"))).cast("long"))
    sized = sized.withColumn("_b", F.expr("(n_rows + _a - 1) div _a"))
    placed = sized.withColumn("_p", permuted("row_number", "n_rows", seed))
    return placed.select(
        *[F.col(f"`{c}`") for c in df.columns], "row_number",
        (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"),
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id with the size and checksum of its text; texts themselves are not shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def op6(docs: DataFrame) -> DataFrame:
    """All documents in shards 0 to 7 by the law ``rows``. Rows of one id are numbered in different buckets, but for equal texts."""
    placed = assign(measured(docs), 8, key=["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
