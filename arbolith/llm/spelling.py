"""Spelling variant grouping without pairs: words one edit apart meet in groups of which only the size and the two commonest words are kept.

Two words differ by one replaced code point if they agree in position, prefix and suffix around it: each word is put into one group a position.
They differ by one inserted or deleted code point if a deletion of the longer one is the shorter one: deletions join the vocabulary. A group
holds at most as many words as there are letters (by places, for deletions), so no key is hot, and each word learns from its groups how many
near words it has and which is the commonest; no two words are ever put side by side.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, written

#: Fewest code points and occurrences of a word; a form is so many times as common as its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Runs of letters to be counted: ASCII and Latin-1. No word has the mark that stands for a replaced letter in the name of a group.
RUN = "[A-Za-zÀ-ÿ]+"
_MARK = "*"
#: One in so many runs loses a letter where documents are damaged.
DAMAGED = 199


def lowered(text: str) -> str:
    """A-Z in lower case, nothing else."""
    return text.encode().lower().decode()


def words_of(text: str, run: re.Pattern, damage: str | None = None, every: int = DAMAGED) -> Counter:
    """The lower-cased runs of a text and their numbers; with ``damage``, those for which ``every`` divides the checksum h of damage, colon and run lack code point h % length."""
    found = Counter(run.findall(lowered(text)))
    if damage is None:
        return found
    start = zlib.crc32(f"{damage}:".encode())
    changed: list[tuple[str, str, int]] = []
    for w, n in found.items():
        h = zlib.crc32(w.encode(), start)
        if h % every == 0:
            at = h % len(w)
            changed.append((w, w[:at] + w[at + 1 :], n))
    for w, _, _ in changed:
        del found[w]
    for _, new, n in changed:
        found[new] += n
    return found


def vocabulary(df: DataFrame, text: str = "text", damage: str | None = None, run: str = RUN, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of all whole texts that are long and common enough.

    Null texts have none. Words are counted a batch of texts at a time before anything is shuffled, so a word of a third of all rows is one row a batch.
    ``damage`` names a column; its values say which runs lose a letter (null: an empty string).
    """
    columns = [F.col(f"`{text}`").alias("text"), *([F.coalesce(F.col(f"`{damage}`").cast("string"), F.lit("")).alias("damage")] if damage else [])]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(run)
        for batch in slices(batches, 4096):
            total: Counter = Counter()
            ids = batch.column("damage").to_pylist() if damage else [None] * batch.num_rows
            for source, i in zip(batch.column("text"), ids, strict=True):
                if found := source.as_py():
                    total.update(words_of(found, pattern, i))
            kept = [(w, n) for w, n in total.items() if len(w) >= least_length]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    counted = df.select(*columns).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def nearest(vocabulary: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``word, n_near, best`` of the words that have near words: how many words differ by exactly one inserted, deleted or replaced code point,
    and the commonest of them as ``(n, word)``, of equally common ones the least in code-point order.

    ``vocabulary`` has distinct words of at least ``least_length`` in ``word``, their numbers in ``n``. One shuffle by groups, one by words.
    """
    places = "sequence(1, length(word))"
    replaced = f"transform({places}, i -> named_struct('of', concat(left(word, i - 1), '{_MARK}', substring(word, i + 1)), 'kind', 0))"
    shorter = f"transform(if(length(word) > {least_length}, array_distinct(transform({places}, i -> concat(left(word, i - 1), substring(word, i + 1)))), array()), x -> named_struct('of', x, 'kind', 1))"
    itself = "array(named_struct('of', word, 'kind', 2))"
    members = vocabulary.select("word", "n", F.explode(F.expr(f"concat({replaced}, {shorter}, {itself})")).alias("g")).select("g.of", "g.kind", "word", "n")
    group = Window.partitionBy("of")
    whole = group.orderBy((F.col("kind") == 2).cast("int"), F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct(F.col("n").alias("n"), F.col("word").alias("word"))
    known = members.withColumns({
        "size": F.count(F.when(F.col("kind") < 2, 1)).over(group), "own": F.max(F.when(F.col("kind") == 2, F.col("n"))).over(group),
        "top": F.first(entry).over(whole), "second": F.nth_value(entry, 2).over(whole),
    })
    # A replaced letter: the others of the group. A deletion: the word that it is, if there is one. A word itself: those of which it is a deletion.
    near = F.expr("case kind when 0 then size - 1 when 1 then if(own is null, 0, 1) else size end")
    best = F.expr("case kind when 0 then if(top.word = word, second, top) when 1 then named_struct('n', own, 'word', of) else top end")
    found = known.select("word", near.alias("near"), best.alias("best")).filter("near > 0")
    least = F.min(F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), least).withColumn("best", F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")))


def roots(forms: DataFrame, deepest: int) -> DataFrame:
    """``word, root``: where the ways of ``word, form`` end, by doubling; no way may have over ``deepest`` steps. Rows are written between the rounds."""
    scratch = Scratch(forms.sparkSession)
    ways = scratch.written(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(max(1, deepest)))):
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways, old = scratch.written(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))), ways
        scratch.drop(old)
    return ways


def variants(df: DataFrame, text: str = "text", damage: str | None = None, run: str = RUN, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of all texts (see ``vocabulary``).

    ``form`` is the commonest near word if that is at least ``ratio`` times as common, else null; ``root`` is where forms lead, the word itself
    without one. Each step is ``ratio`` times as common as the one before, so the commonest word bounds how many there can be.
    Other columns play no part; an empty table gives an empty one.
    """
    counted = written(vocabulary(df, text, damage, run, least_length, least_count))
    most = counted.agg(F.max("n").alias("n")).first().n or 1
    joined = counted.join(nearest(counted, least_length), "word", "left")
    formed = F.expr(f"best.n >= {ratio} * n")
    found = written(joined.select("word", F.when(formed, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.n")).alias("form_n")))
    steps = int(math.log(max(1, most / least_count), ratio)) + 1
    ends = roots(found.filter("form is not null").select("word", "form"), steps)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(docs: DataFrame) -> DataFrame:
    """Words of all documents, damaged by their ids (null: an empty string), and their forms. Null texts have no words; repeated documents count again."""
    return variants(docs, damage="doc_id")
