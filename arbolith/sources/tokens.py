"""Tokens of brace syntax as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import brace

TOKENS = "doc_id bigint, i int, kind string, text string, line int, col int"


def tokenize(df: DataFrame, content: Column | str, doc_id: Column | str = "doc_id") -> DataFrame:
    """Rows of TOKENS; a text that isn't brace syntax gives one of kind error with the message. Null texts give none."""
    content = F.col(content) if isinstance(content, str) else content
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id

    def rows(k: int, text: str) -> list[tuple]:
        try:
            return [(k, i, *t) for i, t in enumerate(brace.tokenize(text))]
        except brace.ParseError as e:
            return [(k, 0, "error", str(e), e.line, e.column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [r for k, t in zip(part.column("k").to_pylist(), part.column("t").to_pylist(), strict=True) for r in rows(k, t)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "i", "kind", "text", "line", "col"])

    return df.select(doc_id.cast("long").alias("k"), content.alias("t")).filter("t is not null").mapInArrow(run, TOKENS)
