"""Words and shingles of many texts at once, in numpy.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``, with A-Z
lower-cased. Words and shingles are named by 64-bit hashes: sums of random
values of their bytes (or words) times powers of an odd base, then mixed. Two
different names in a table of n collide with a probability of about n / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 512 << 10
LEVELS = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240611).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDY = np.ones(256, bool)
_WORDY[[32, 9, 10, 11, 12, 13]] = False
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse; those for a chunk are kept, those for a longer text are not."""
    if len(_powers[0]) >= n:
        return _powers
    found = []
    for base in (_BASE, _INVERSE):
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        found.append(np.cumprod(steps))
    if n <= CHUNK_BYTES + 1:
        _powers[:] = found
    return found


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, a longer text alone."""
    sizes = np.diff(offsets_of(column))
    begin, load = 0, 0
    for k, size in enumerate(sizes):
        if k > begin and load + size > most:
            yield begin, k
            begin, load = k, 0
        load += int(size)
    if begin < len(column):
        yield begin, len(column)


def offsets_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def most_frequent(counts: DataFrame, name: str, times: str, most: int) -> DataFrame:
    """About ``most`` rows of ``counts`` with the greatest ``times``, or all if there are no more.

    Counts are told apart by level, ``LEVELS`` to each doubling; of the level
    that does not fit whole as many as there is room for are taken by the hash
    of ``name``, so the result is never empty and its size is bounded.
    """
    level = F.floor(F.log2(times) * LEVELS).cast("int")
    sizes = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 64 * LEVELS rows
    room, last, share = most, -1, None
    for at, n in sizes:
        if n > room:
            last, share = at, (room, n)
            break
        room -= n
    chosen = level > last
    if share:
        chosen |= (level == last) & (F.pmod(F.xxhash64(name), F.lit(share[1])) < share[0])
    return counts.where(chosen)


class Words:
    """The words of some rows of a binary column without nulls.

    ``first[d]`` is the index of row d's first word, ``first[-1]`` the number of
    words; ``starts`` and ``ends`` are byte positions in ``data``.
    """

    def __init__(self, column: pa.Array, begin: int, end: int):
        offsets = offsets_of(column)[begin : end + 1]
        base = offsets[0] if len(offsets) else 0
        raw = np.frombuffer(column.buffers()[2], np.uint8)[base : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.data = _LOWER[raw]
        self.offsets = offsets - base
        n = len(self.data)
        wordy = np.zeros(n + 2, bool)
        wordy[1:-1] = _WORDY[self.data]
        opens, closes = wordy[1:-1] & ~wordy[:-2], wordy[1:-1] & ~wordy[2:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        opens[edges] |= wordy[1:-1][edges]
        closes[edges - 1] |= wordy[1:-1][edges - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit name of every word."""
        powers, inverse = _powers_to(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_VALUES[self.data] * powers[: len(self.data)], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all runs of ``size`` words in a row's text, and their first index by row.

    A text with fewer words has its whole sequence as one run, one without words
    none.
    """
    h = words.hashes()
    counts = words.counts
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + h[k : k + len(out)]
    own = np.maximum(counts - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), own)
    begin = np.concatenate([[0], np.cumsum(own)])
    at = words.first[:-1][row] + (np.arange(begin[-1]) - begin[:-1][row])
    full = mix(out[at] + np.uint64(size))
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return full, begin
    whole = []
    for d in short:
        s = np.zeros(1, np.uint64)
        for w in h[words.first[d] : words.first[d + 1]]:
            s = s * np.uint64(_BASE) + w
        whole.append(mix(s + np.uint64(counts[d]))[0])
    own[short] = 1
    all_begin = np.concatenate([[0], np.cumsum(own)])
    names = np.zeros(all_begin[-1], np.uint64)
    names[all_begin[short]] = whole
    long_rows = np.ones(len(names), bool)
    long_rows[all_begin[short]] = False
    names[long_rows] = full
    return names, all_begin
