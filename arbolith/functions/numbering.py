"""Numbers without gaps over a whole table, and running sums, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(df: DataFrame, part: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its column over all rows before: those of lower ``part``, and those of the same one that are before by ``order``.

    One sum a part is put in front of it: the parts' own sums, of which there must be few enough for one task, are summed up and broadcast.
    """
    names = list(sums)
    totals = df.groupBy(part).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(part).alias("_part"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumns({f"_s_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    out = own.join(F.broadcast(offsets), F.col(part) == F.col("_part"))
    return out.withColumns({n: F.col(f"_s_{n}") + F.col(f"_o_{n}") for n in names}).drop("_part", *[f"{p}{n}" for n in names for p in ("_s_", "_o_")])


def running(df: DataFrame, sums: dict[str, Column], where: str, *order: Column, parts: int | None = None) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its column over all rows before in ``order``, which has to tell all rows apart.

    Rows are dealt to ``parts`` ranges of the order (as many as a shuffle has partitions by default), which are summed up by themselves and moved by the sums of those
    before. What range a row is in is drawn by a sample, so it is written with the rows to ``where``, a new folder that driver and executors share, and not made twice.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(where)
    held = spark.read.schema(dealt.schema).parquet(where)
    return carried(held, "_range", list(order), sums).drop("_range")


def gapless(df: DataFrame, name: str, where: str, *order: Column, start: int = 0, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the number of each row in ``order``, which has to tell all rows apart, from ``start``. Written and dealt as ``running``."""
    return running(df, {name: F.lit(1).cast("long")}, where, *order, parts=parts).withColumn(name, F.col(name) + start)
