"""Token counts of whole texts, with huge texts encoded in overlapping chunks that are spliced at stable boundaries."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts
from .splitting import Splitter

#: Characters of a chunk and of the overlap of two chunks; a longer text is a huge document.
CHUNK, OVERLAP = 65_536, 512
#: Matches whose counts a Python worker keeps.
CACHE = 600_000
LIMIT = 1024
#: The pattern by which byte-level pre-tokenizers split, and the blocks whose letters, numbers and spaces
#: have been the same in all versions of Unicode since 9.0. Texts with other characters go to the library whole.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER = re.compile("[^\x00-ͷЀ-ԧḀ-῿ -⁯₠-₽←-⏳ぁ-ゖ゠-ヿ、-〃〈-】！-／：-＠一-鿌가-힣]")
#: A place where every byte-level tokenizer ends a piece, whatever stands around it: no part of the pattern goes on from a
#: character that is not white space to one that is, and what follows is split as if the text began there.
STABLE = re.compile(r"(?<=\S) (?=\S)")
#: More such places, for texts with few spaces: between letters, numbers and other characters. None is behind an apostrophe, which
#: can begin a part with letters; both characters have to be of the blocks above.
CLASS_ENDS = regex.compile(r"(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


class Counter:
    """Counts tokens as a tokenizer of the ``tokenizers`` library gives them: no special tokens added, those in a text kept whole."""

    def __init__(self, json: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        added = self.tokenizer.get_added_tokens_decoder().values()
        pre = self.tokenizer.pre_tokenizer
        plain = isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and pre.use_regex and self.tokenizer.normalizer is None
        self.by_match = plain and not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        if self.by_match:
            # offsets that keep a token's leading space
            self.tokenizer.post_processor = None
        self.split = Splitter(BYTE_LEVEL_PATTERN)
        self.special = re.compile("|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content)))) if added else None
        self.longest = max((len(t.content) for t in added), default=0)
        self.known: dict[str, int] = {}
        #: How often no common boundary was found and an overlap was widened.
        self.widened = 0

    def _encoded(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def _spliced(self, text: str) -> int:
        """Count of a huge text.

        Each chunk begins ``overlap`` characters before the last one's end. The two are spliced at a stable place in the
        overlap at which both encodings have a token boundary: the last one counts up to it, the next one from it. Where
        there is none, the overlap doubles to both sides and the chunks are encoded again, up to the whole text.
        """
        total, start, counted_from = 0, 0, 0
        end = min(len(text), self.chunk)
        left = self._encoded(text[start:end]).offsets
        while end < len(text):
            overlap = self.overlap
            while True:
                stop = min(len(text), end + overlap - self.overlap)
                if stop != end:
                    end = stop
                    left = self._encoded(text[start:end]).offsets
                if end == len(text):
                    break
                begin = max(counted_from, end - overlap)
                reach = min(len(text), begin + max(self.chunk, 2 * overlap))
                right = self._encoded(text[begin:reach]).offsets
                if (found := self._boundary(text, start, left, begin, right, end, counted_from)) is not None:
                    break
                overlap *= 2
            if end == len(text):
                break
            place, up_to = found
            total += up_to - self._first(left, start, counted_from)
            start, end, left, counted_from = begin, reach, right, place
        return total + len(left) - self._first(left, start, counted_from)

    @staticmethod
    def _first(offsets: list[tuple[int, int]], start: int, place: int) -> int:
        """Number of tokens that end at or before ``place``."""
        lo, hi = 0, len(offsets)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if start + offsets[mid][1] <= place else (lo, mid)
        return lo

    def _in_special(self, text: str, place: int) -> bool:
        """Whether a special token of the text goes across ``place``."""
        if not self.special:
            return False
        return any(m.start() < place < m.end() for m in self.special.finditer(text, max(0, place - self.longest), place + self.longest))

    def _boundary(self, text, start, left, begin, right, end, least):
        """A stable place in the overlap, and the number of the left chunk's tokens before it."""
        for kind in (STABLE, CLASS_ENDS):
            places = [m.start() for m in kind.finditer(text, begin, end)]
            for place in places[len(places) // 2 :] + places[: len(places) // 2]:
                if place <= least or place <= begin or OTHER.search(text, place - 1, place + 1) or self._in_special(text, place):
                    continue
                a, b = self._first(left, start, place), self._first(right, begin, place)
                if a < len(left) and b < len(right) and start + left[a][0] >= place and begin + right[b][0] >= place:
                    return place, a
        self.widened += 1
        return None

    def _learn(self, matches: set[str]) -> None:
        new = [m for m in matches if m not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(matches)
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            self.known.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))

    def count_all(self, many: list[str]) -> list[int]:
        out = [0] * len(many)
        found: list[tuple[int, list[str]]] = []
        for k, text in enumerate(many):
            if len(text) > self.chunk and self.by_match:
                out[k] = self._spliced(text)
            elif not self.by_match or OTHER.search(text):
                out[k] = len(self._encoded(text))
            elif self.special and self.special.search(text):
                out[k] = sum(1 for _ in self.special.finditer(text))
                found += [(k, self.split(part)) for part in self.special.split(text)]
            else:
                found.append((k, self.split(text)))
        self._learn(set().union(*(m for _, m in found)))
        for k, matches in found:
            out[k] += sum(map(self.known.__getitem__, matches))
        return out


_COUNTERS: dict[str, Counter] = {}


def counts(df: DataFrame, json: str, text: str = "text", out: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and ``out``: long, the number of tokens of each whole text; replaces a column of that name.

    ``json``: a tokenizer file's content. Null counts as empty and has 0 tokens. Nothing is shuffled, no text is cut short.
    A text up to CHUNK characters is counted match by match, each distinct match by the library once; a longer one is encoded
    in overlapping chunks. Tokenizers other than plain byte-level ones get every text whole.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).withColumn(out, F.lit(0).cast("long")).schema
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    shared = df.sparkSession.sparkContext.broadcast(json)  # a vocabulary: fixed size
    key = hashlib.sha256(json.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(shared.value)
        for batch in slices(batches, 256):
            found = pa.array(_COUNTERS[key].count_all(texts(batch.column(text))), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], found], [*kept, out])

    return df.mapInArrow(run, schema)


def op7(docs: DataFrame, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        json = f.read()
    size = docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    counted = counts(size, json, keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
