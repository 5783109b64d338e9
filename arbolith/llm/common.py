"""What the training-data operators share: the shared folder, written tables, joins on hot keys, text batches."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that may be called hot: those with over a HOT-th of the rows, so there are fewer than HOT of them.
HOT = 2048


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="arbolith-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset and Spark runs in one process, a folder of our own."""
    conf = spark.sparkContext.getConf()
    if named := conf.get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir()


class Scratch:
    """Tables written to the shared folder; they cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/arbolith/{uuid.uuid4().hex}"
        self.tables: list[DataFrame] = []

    def _path(self, number: int) -> str:
        return f"{self.root}/{number}"

    def written(self, df: DataFrame) -> DataFrame:
        path = self._path(len(self.tables))
        df.write.parquet(path)
        self.tables.append(self.spark.read.schema(df.schema).parquet(path))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for number, t in enumerate(self.tables):
            if any(t is x for x in tables):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(number))
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    return Scratch(df.sparkSession).written(df)


def joined_on(rows: DataFrame, facts: DataFrame, key: list[str], total: int, n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row a key and in ``n`` how many of the ``total`` rows have it.

    Facts of hot keys, fewer than HOT, are broadcast, so their rows stay where they are; all others are joined by a shuffle.
    """
    most = max(64, total // HOT)
    hot = F.broadcast(facts.filter(F.col(n) > most))
    cold = rows.join(hot.select(*key), key, "left_anti").join(facts.filter(F.col(n) <= most), key)
    return rows.join(hot, key).unionByName(cold)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows and, but for a row that is longer by itself, few bytes, so that few texts are Python objects at once."""
    for batch in batches:
        wide = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        lengths = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in wide), np.zeros(batch.num_rows, np.int64))
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            room = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            end = min(at + rows, max(at + 1, room))
            yield batch.slice(at, end - at)
            at = end


def texts(column: pa.Array) -> list[str]:
    """Whole texts; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
