"""From raw documents to packed training sequences: quality, near duplicates, repeated passages, personal data, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet
and reads again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolith.llm import near_dedup, packing, pii, quality, substrings
from arbolith.llm.common import Scratch, documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, fitted on these documents, takes for good.

    Null and empty texts are scored like others, by what the labellers' shares and the scorer's bias say; repeated rows get the
    same score and go or stay together; texts are read whole. An empty table stays empty.
    """
    return quality.classify(docs, quality.fit(docs)).filter("kept").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of least doc_id.

    Rows of null id, and those without words (null, empty or blank texts), stay. Rows that share a doc_id are judged each by
    its own text; of rows repeated whole one goes on.
    """
    return near_dedup.representatives(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages that other documents or earlier parts hold; a document of which nothing is left goes.

    Null and empty texts stay as they are. Rows of null id come after all others and, like rows of one id, don't take passages
    from each other. Texts are cut and compared whole, whatever their length; an empty table stays empty.
    """
    left = substrings.deduplicate(docs)
    return _columns(left.filter("size(removed_spans) = 0 or trim(text) != ''"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts marks such as [EMAIL] in place of personal data, in texts of any length. A null text stays null; repeated rows are treated alike."""
    return _columns(pii.detect(docs, redact="text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences: a row for each piece of a document, with its bin and its place there.

    A null or empty text takes one unit, its end mark; a very long one is cut into pieces. Null and repeated ids are packed like others.
    """
    return packing.pack(docs, packing.byte_length(F.col("text")), spread=F.xxhash64("text"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: A trained classifier and randomised joins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written as Parquet and read again. Of an empty table nothing is left; columns beside those of documents are ignored."""
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    for _, stage in STAGES:
        before, docs = docs, scratch.written(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return docs
