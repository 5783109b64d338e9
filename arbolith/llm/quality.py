"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

BAD, GOOD, ABSTAIN = 0, 1, 2
#: The scorer is fitted on about this many rows, chosen by a hash of id and text, and never on more than twice as many.
SAMPLE = 8192
#: Buckets into which features are hashed.
WIDTH = 2048
SEED = 17
LABELLERS = ("symbols", "capitals", "echoes", "variety", "short_words", "sentences", "word_length", "lines", "separators")
#: A token of these alone is no word.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Classes of bytes, of which the scorer sees runs of three: capitals, small letters and parts of other characters, digits, spaces, line ends, the rest one by one.
_CLASS = np.arange(256) % 27 + 5
_CLASS[:128] = [i % 27 + 5 for i in range(128)]
for _set, _k in ((range(65, 91), 0), (range(97, 123), 1), (range(128, 256), 1), (range(48, 58), 2), ((9, 11, 12, 13, 32), 3), ((10,), 4)):
    _CLASS[list(_set)] = _k
_CLASS = _CLASS.astype(np.int64)
_BUCKET = ((np.arange(1 << 15, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % WIDTH


@dataclass(frozen=True, slots=True)
class Measures:
    words: int
    symbols: float
    capitals: float
    echoes: float
    variety: float
    short: float
    ends: float
    length: float
    lines: int
    repeated_lines: float
    separators: float


def measure(text: str, raw: np.ndarray) -> Measures:
    """Of a whole text; ``raw`` has its UTF-8 bytes."""
    tokens = text.split()
    words = [w for w in tokens if w.strip(MARKS)]
    n = max(1, len(words))
    seen = np.bincount(raw, minlength=256)
    letters = int(seen[65:91].sum() + seen[97:123].sum() + seen[192:].sum())
    lines = text.split("\n")
    return Measures(
        words=len(words),
        symbols=float(seen[[33, 35, 36, 37, 38, 42, 94, 95, 124, 126]].sum()) / n,
        capitals=float(seen[65:91].sum()) / max(1, letters),
        echoes=sum(map(operator.eq, tokens, tokens[1:])) / n,
        variety=len(set(words)) / n,
        short=sum(map((1, 2, 3).__contains__, map(len, words))) / n,
        ends=float(seen[[46, 63, 33]].sum()) / n,
        length=sum(map(len, words)) / n,
        lines=len(lines),
        repeated_lines=1 - len(set(lines)) / len(lines),
        separators=1 - len(words) / max(1, len(tokens)),
    )


def votes(m: Measures) -> list[int]:
    """One of BAD, GOOD and ABSTAIN for each of LABELLERS."""

    def of(bad: bool, good: bool, least: int = 1) -> int:
        return ABSTAIN if m.words < least else BAD if bad else GOOD if good else ABSTAIN

    return [
        of(m.symbols > 0.15, m.symbols < 0.02),
        of(m.capitals > 0.3, m.capitals < 0.1, 4),
        of(m.echoes > 0.15, m.echoes < 0.02, 8),
        of(m.variety < 0.35, m.variety > 0.55, 30),
        of(m.short < 0.1, 0.2 < m.short < 0.5, 15),
        of(m.ends < 0.015 or m.ends > 0.6, 0.03 < m.ends < 0.25, 30),
        of(m.length > 6.8 or m.length < 3, 4 < m.length < 6.3, 15),
        of(m.repeated_lines > 0.3, m.repeated_lines == 0 and m.lines > 2, 15),
        of(m.separators > 0.15, m.separators < 0.02, 8),
    ]


def pattern(v: list[int]) -> int:
    return sum(x * 3**i for i, x in enumerate(v))


def estimate(patterns: dict[int, int], rounds: int = 200) -> tuple[np.ndarray, float, dict[int, float]]:
    """Expectation-maximisation over counts of vote patterns, of which there are 3 ** 9 at most.

    Returns P(vote | class and vote given) by class, labeller and vote; the share of good documents; and for each pattern the posterior of
    good. Votes are taken as independent given the class. Classes start from the share of good votes, which also names them.
    """
    keys = sorted(patterns)
    v = np.array([[k // 3**i % 3 for i in range(len(LABELLERS))] for k in keys], int).reshape(-1, len(LABELLERS))
    n = np.array([patterns[k] for k in keys], float)
    good, bad = (v == GOOD).sum(axis=1), (v == BAD).sum(axis=1)
    q = np.clip(np.where(bad > 0, 0.3 * good / np.maximum(1, good + bad), 0.95), 0.02, 0.98)
    p, share = np.ones((2, len(LABELLERS), 3)), 0.5
    for _ in range(rounds):
        for c, w in ((BAD, n * (1 - q)), (GOOD, n * q)):
            p[c] = 0
            for x in (BAD, GOOD):
                p[c, :, x] = (w[:, None] * (v == x)).sum(axis=0) + 0.5
            p[c] /= p[c].sum(axis=1, keepdims=True)
            p[c, :, ABSTAIN] = 1  # to abstain says nothing
        share = float(np.clip((n * q).sum() / max(1.0, n.sum()), 0.01, 0.99))
        logs = [np.log(p[c][np.arange(len(LABELLERS)), v]).sum(axis=1) for c in (BAD, GOOD)]
        new = 1 / (1 + np.exp(np.clip(logs[BAD] - logs[GOOD] + np.log((1 - share) / share), -50, 50)))
        done, q = np.abs(new - q).max(initial=0) < 1e-6, new
        if done:
            break
    return p, share, dict(zip(keys, q.tolist(), strict=True))


def features(m: Measures, raw: np.ndarray) -> np.ndarray:
    """Hashed: root of the share of each run of three byte classes, and the measures in steps."""
    x = np.zeros(WIDTH)
    if len(raw) > 2:
        k = _CLASS[raw]
        x = np.sqrt(np.bincount(_BUCKET[k[:-2] << 10 | k[1:-1] << 5 | k[2:]], minlength=WIDTH) / len(raw))
    steps = (m.symbols * 10, m.capitals * 10, m.echoes * 10, m.variety * 10, m.short * 10, m.ends * 10, m.length, m.repeated_lines * 10, m.separators * 10)
    few = min(3, m.words.bit_length() // 2)
    for i, s in enumerate(steps):
        x[(int(min(30, s)) * 0x9E37 + i * 0x79B9 + few * 0x7F4A) * 40503 % WIDTH] += 0.5
    return x


@dataclass(frozen=True)
class Model:
    posteriors: dict[int, float]
    weights: np.ndarray
    bias: float
    accuracies: dict[str, float]
    share: float

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -50, 50))))


def _fit_linear(x: np.ndarray, q: np.ndarray, steps: int = 300, rate: float = 0.2, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; both classes weigh alike. Full-batch Adam, so the result depends on the rows only."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    if not len(x):
        return w, 1.0  # nothing is known: all is kept
    balance = np.where(q > 0.5, 0.5 / max(1, (q > 0.5).sum()), 0.5 / max(1, (q <= 0.5).sum())).astype(np.float32)
    first, second = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        error = ((1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) - q) * balance).astype(np.float32)
        g = np.append(x.T @ error + decay * w, error.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w, float(b)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def fit(df: DataFrame, text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fits labellers' accuracies on the votes of all rows and the scorer on a bounded sample (see SAMPLE)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [pattern(votes(measure(x, _bytes(x)))) for x in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], ["pattern"])

    counted = rows.select("text").mapInArrow(vote, "pattern int").groupBy("pattern").count().collect()  # 3 ** 9 rows at most
    patterns = {r["pattern"]: r["count"] for r in counted}
    p, share, posteriors = estimate(patterns)
    part = min(1.0, sample / max(1, sum(patterns.values())))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for x in texts(batch.column("text")):
                raw = _bytes(x)
                m = measure(x, raw)
                f = features(m, raw).astype(np.float32)
                at = np.flatnonzero(f).astype(np.int16)
                out.append((pattern(votes(m)), at.tobytes(), f[at].tobytes()))
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(a, pa.int32()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], ["h", "pattern", "at", "value"])

    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    chosen = hashed.filter(F.pmod(F.col("h"), F.lit(1 << 30)) < int(part * (1 << 30))) if part < 1 else hashed
    got = sorted((r["h"], r["pattern"], bytes(r["at"]), bytes(r["value"])) for r in chosen.select("h", "text").mapInArrow(featured, "h long, pattern int, at binary, value binary").limit(2 * sample).collect())
    x, q = np.zeros((len(got), WIDTH), np.float32), np.zeros(len(got), np.float32)
    for i, (_, k, at, value) in enumerate(got):
        x[i, np.frombuffer(at, np.int16)] = np.frombuffer(value, np.float32)
        q[i] = posteriors[k]
    weights, bias = _fit_linear(x, q)
    right = share * p[GOOD, :, GOOD] + (1 - share) * p[BAD, :, BAD]
    return Model(posteriors, weights, bias, dict(zip(LABELLERS, right.round(4).tolist(), strict=True)), share)


def classify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and weak_label (the posterior of good by the votes), quality_score and kept.

    Columns of those names are replaced. ``kept``: a score of 0.5 or more. Null counts as empty. A text on which all
    labellers abstain, as an empty one, is scored like others. Repeated rows get the same score. Nothing is shuffled.
    """
    added = ["weak_label", "quality_score", "kept"]
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).withColumns({"weak_label": F.lit(0.0), "quality_score": F.lit(0.0), "kept": F.lit(True)}).schema
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    shared = df.sparkSession.sparkContext.broadcast(model)  # WIDTH weights and 3 ** 9 posteriors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            label, score = [], []
            for x in texts(batch.column(text)):
                raw = _bytes(x)
                m = measure(x, raw)
                label.append(model.posteriors.get(pattern(votes(m)), model.share))
                score.append(round(model.score(features(m, raw)), 6))
            columns = [pa.array(label, pa.float64()), pa.array(score, pa.float64()), pa.array([s >= 0.5 for s in score], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], [*kept, *added])

    return df.mapInArrow(run, schema)


def op10(docs: DataFrame) -> DataFrame:
    return classify(docs, fit(docs), keep=["doc_id"])
