"""Quality scores: ridge on random Fourier features of document statistics, then isotonic calibration.

Statistics come from the text alone. Random Fourier features approximate a
Gaussian kernel over them; every partition sums its share of the normal
equations, the sums are added pairwise in fewer tasks, and the driver solves one
system whose size is the number of features. Scores of labelled rows that the
fit has not seen are calibrated by pooling adjacent violators over equal bins.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.workspace import keep

FOURIER = 192
BANDWIDTH = 3.0
RIDGE = 1e-3
BINS = 512
SUM_TASKS = 8
SEED = 20240607

# Character classes that statistics count, as ASCII bytes.
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
DIGITS = b"0123456789"
STOPS = b".,;:?'\"()-"
SIGNS = b"!#$%&*+/<=>@[\\]^_`{|}~"
BLANKS = b" \t\n\v\f\r"
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_spread", "distinct_words", "top_word", "upper_share", "digit_share",
    "stop_share", "sign_share", "blank_share", "wide_share", "repeated_lines", "line_length", "signed_words", "capital_words", "plain_words",
)


def statistics(text: bytes) -> list[float]:
    """The statistics of one text; an empty text gives zeros."""
    n = len(text)
    words = text.split()
    if not words:
        return [math.log1p(n)] + [0.0] * (len(STATISTICS) - 1)
    count = lambda which: n - len(text.translate(None, which))
    upper, lower = count(UPPER), count(LOWER)
    letters = max(1, upper + lower)
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    kinds = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    wide = n - len(text.decode("utf-8", "replace"))
    signed = capital = plain = 0
    for word, times in kinds.items():
        signed += times * (len(word.translate(None, SIGNS)) < len(word))
        capital += times * (word.isupper() and len(word) > 1)
        plain += times * word.isalpha()
    m = len(words)
    return [
        math.log1p(n), math.log1p(m), math.log1p(len(lines)), lengths.mean(), lengths.std(), len(kinds) / m, max(kinds.values()) / m, upper / letters, count(DIGITS) / n,
        count(STOPS) / n, count(SIGNS) / n, count(BLANKS) / n, wide / n, 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), signed / m, capital / m, plain / m,
    ]


def with_statistics(docs: DataFrame, key: str, text: str, also: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the statistics of every row's whole text and the columns ``also``; a null text counts as empty."""
    rows = docs.select(F.col(text).cast("binary"), F.col(key), *also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x.as_py() or b"") for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.float64()))], ["key", *also, "f"])

    given = "".join(f"`{c}` {rows.schema[k].dataType.simpleString()}, " for k, c in enumerate([key, *also], 1))
    return rows.mapInArrow(run, given + "f array<double>")


@dataclass(frozen=True)
class Model:
    """A fitted scorer: ``raw`` is the ridge's output, ``score`` the calibrated one."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    level: np.ndarray

    def features(self, f: np.ndarray) -> np.ndarray:
        return fourier(f, self.mean, self.spread)

    def raw(self, f: np.ndarray) -> np.ndarray:
        return self.features(f) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(f), self.at, self.level) if len(self.at) else np.full(len(f), 0.5)


def fourier(f: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    directions = rng.standard_normal((f.shape[1], FOURIER)) / BANDWIDTH
    phases = rng.uniform(0, 2 * np.pi, FOURIER)
    z = np.clip((f - mean) / spread, -6, 6)
    return np.hstack([np.cos(z @ directions + phases) * math.sqrt(2 / FOURIER), np.ones((len(f), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def pooled(hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of hits by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for hit, n in zip(hits, counts, strict=True):
        blocks.append([hit, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            hit, n, size = blocks.pop()
            blocks[-1] = [blocks[-1][0] + hit, blocks[-1][1] + n, blocks[-1][2] + size]
    return np.concatenate([np.full(int(size), hit / n) for hit, n, size in blocks]) if blocks else np.zeros(0)


def fit(labelled: DataFrame, unseen: DataFrame) -> Model:
    """Fits on ``labelled(f, y)`` and calibrates on ``unseen(f, y)``; with neither, every score is one half."""
    k = len(STATISTICS)
    m = labelled.agg(*[F.avg(F.col("f")[i]) for i in range(k)], *[F.stddev_pop(F.col("f")[i]) for i in range(k)]).first()
    none = np.zeros(0)
    if m[0] is None:
        return Model(np.zeros(k), np.ones(k), np.zeros(FOURIER + 1), none, none)
    mean, spread = np.array(m[:k], float), np.array(m[k:], float)
    spread[spread < 1e-9] = 1.0
    size = FOURIER + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            x = fourier(_matrix(batch.column(0)), mean, spread)
            total += x.T @ np.column_stack([x, batch.column(1).to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * (size + 1))
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = labelled.select("f", F.col("y").cast("double")).mapInArrow(sums, "part binary")
    parts = parts.repartition(SUM_TASKS).mapInArrow(added, "part binary").collect()
    total = sum(np.frombuffer(p.part) for p in parts).reshape(size, size + 1)
    gram, target = total[:, :size], total[:, size]
    weights = np.linalg.solve(gram + RIDGE * max(1.0, gram[-1, -1]) * np.eye(size) / size, target)
    model = Model(mean, spread, weights, none, none)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(model.raw(_matrix(batch.column(0))), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor((raw + 0.5) / 2 * BINS).astype(np.int32)), batch.column(1)], ["bin", "y"])

    bins = unseen.select("f", F.col("y").cast("double")).mapInArrow(binned, "bin int, y double")
    bins = sorted(bins.groupBy("bin").agg(F.sum("y").alias("hits"), F.count("*").alias("n")).collect())  # at most BINS + 1 rows
    if not bins:
        return Model(mean, spread, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    at = (np.array([b.bin for b in bins]) + 0.5) / BINS * 2 - 0.5
    level = pooled(np.array([b.hits for b in bins], float), np.array([b.n for b in bins], float))
    return Model(mean, spread, weights, at, level)


def score(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 3, held: int = 1, also: tuple[str, ...] = ()
) -> DataFrame:
    """``key``, held_out, score, predicted and the columns ``also`` of every row of ``docs``.

    A row is held out if crc32 of its key as text leaves ``held`` on division by
    ``folds``; the fit uses the fold after it, the calibration the others. All
    labelled rows of those folds are used. Empty and null texts have statistics
    of zero and a score like any other; a null key is not held out and has no
    label, nor does a null label count. Repeated rows are scored alike and, where
    labelled, counted as often as they occur. Without labels every score is one
    half. Other columns are left out.
    """
    fold = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))
    rows = keep(with_statistics(docs, key, text, also), "quality-statistics").withColumn("fold", F.coalesce(fold, F.lit(-1)))
    marks = labels.select(F.col(key), F.col(label).alias("y")).where(F.col("y").isNotNull())
    known = keep(rows.where(F.col("fold") != held).join(marks, key).select("f", "y", "fold"), "quality-labelled")
    fitting = (held + 1) % folds
    model = fit(known.where(F.col("fold") == fitting), known.where(F.col("fold") != fitting))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.clip(model.score(_matrix(batch.column(2))), 0, 1) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(s), pa.array((s >= 0.5).astype(np.int32)), *batch.columns[3:]], ["key", "held_out", "score", "predicted", *also])

    rows = rows.select(key, (F.col("fold") == held).alias("held_out"), "f", *also)
    given = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in also)
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, held_out boolean, score double, predicted int{given}")
