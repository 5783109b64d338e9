"""Lines of text in motion: each line is a document, steps keep no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines of text files under ``path``, as ``value``."""
    return spark.readStream.text(path)


def run(lines: DataFrame, steps: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs batch steps on what is there now, a batch at a time; ``steps`` gets the batch and its number."""
    return lines.writeStream.foreachBatch(steps).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(lines: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Appends what ``make`` makes of the lines to a Parquet table, each line once."""
    return make(lines).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
