"""Benchmark decontamination by latent semantic retrieval.

A randomised singular value decomposition of all TF-IDF passages, computed over
Spark partitions, gives every word a place in a latent space of fixed rank. Its
vocabulary is that of the corpus, hashed to ``FEATURES``, so words that stand
with the same other words lie near each other and a paraphrase comes near its
item. Every window of every document is projected and compared with all items by
cosine; a candidate is confirmed by the longest common subsequence of words with
the item, or by a shorter one together with the item's answer.

Which directions the space keeps depends on the corpus, so items that are held
word for word, shortened or changed are found exactly beside it: windows that go
by an item's length are counted for its words and their weights, and no stretch
of up to twice the item's words that would be confirmed is passed over.

Every text is cut into words once for all items; items are searched for in
blocks. Documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Words, chunks
from tessera.llm.workspace import keep

ITEMS_A_BLOCK = 256
GROUP_BYTES = 32 << 20
FEATURES = 1 << 13
STARTS_BITS = 16
RANK = 64
OVERSAMPLED = 8
FEATURES_A_ROW = 512
LEVEL = 64
STEP = 16
WINDOWS = (2, 4)  # in steps, powers of two
PASSAGE = 32
LATENT = 0.7
COMMON = 0.1
PAIRS_AT_ONCE = 1 << 13
WORDS_JOINED = 128
COSINE = 0.45
SUBSEQUENCE = 0.6
WITH_ANSWER = 0.45
ANSWER_WORDS = 4
LEAST_WORDS = 5
LEAST_ROOM = 8
WORDS_AT_ONCE = 1 << 17
WORDS_MULTIPLIED = 1 << 14
ROWS_ADDED = 32
STRETCHES_AT_ONCE = 1 << 10
WINDOWS_AT_ONCE = 4096
SEED = 5
DOCS = -1  # in counts: the number of documents

_KEPT = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_ \t\n\v\f\r"
_SIGNS = bytes(c for c in range(128) if c not in _KEPT)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_NO_WORD = re.compile(r"[^\w \t\n\x0b\f\r]+")
_NO_WORD_BUT_ASCII = re.compile(r"[^\x00-\x7f\w]+")
_UNTOLD = "\ufffd\u03a3"  # bytes that are no text, and the letter whose lower case depends on the signs around it


def normal(text: bytes) -> bytes:
    """A text without case and without anything but letters, digits, underscores and ASCII white space."""
    if text.isascii():
        return text.translate(_LOWER, _SIGNS)
    whole = text.decode("utf-8", "replace")
    if any(c in whole for c in _UNTOLD):
        return _NO_WORD.sub("", whole.lower()).encode()
    return _NO_WORD_BUT_ASCII.sub("", text.translate(_LOWER, _SIGNS).decode().lower()).encode()


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of some texts, and each text's first."""
    words = Words(pa.array([normal(t) for t in texts], pa.binary()), 0, len(texts))
    return words.hashes(), words.first


def feature_of(names: np.ndarray) -> np.ndarray:
    """The latent feature of each word name."""
    return (names % np.uint64(FEATURES)).astype(np.int32)


def numbered(names: np.ndarray, terms: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Places of word names among the sorted ``terms``, by their ``starts`` if given; of other words ``-1 - feature``."""
    other = -1 - feature_of(names)
    if not len(terms):
        return other
    if starts is None:
        at = np.minimum(np.searchsorted(terms, names), len(terms) - 1)
    else:
        at = starts.take((names >> np.uint64(64 - STARTS_BITS)).astype(np.int64))
        for _ in range(int(np.diff(starts).max(initial=0))):
            at += terms.take(at, mode="clip") < names
        at = np.minimum(at, len(terms) - 1)
    return np.where(terms.take(at) == names, at.astype(np.int32), other)


def starts_of(terms: np.ndarray) -> np.ndarray:
    """Where the sorted ``terms`` with each STARTS_BITS first bits begin, and their number."""
    return np.append(np.searchsorted(terms, np.arange(1 << STARTS_BITS, dtype=np.uint64) << np.uint64(64 - STARTS_BITS)), len(terms))


def row_sums(table: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of the rows ``at`` of ``table`` over stretches of them: the first of many stretches at a time, then the second and so on.

    Stretches of more than ROWS_ADDED rows are cut into parts whose sums are added in the same way.
    """
    n = end - begin
    if n.max(initial=0) > ROWS_ADDED:
        own = -(-n // ROWS_ADDED)
        last = np.cumsum(own)
        low = np.repeat(begin - (last - own) * ROWS_ADDED, own) + np.arange(own.sum()) * ROWS_ADDED
        parts = row_sums(table, at, low, np.minimum(low + ROWS_ADDED, np.repeat(end, own)))
        return row_sums(parts, np.arange(len(parts)), last - own, last)
    out = np.zeros((len(begin), table.shape[1]), table.dtype)
    order = np.argsort((ROWS_ADDED - n).astype(np.uint16), kind="stable")
    for some in range(0, len(order), STRETCHES_AT_ONCE):
        own = order[some : some + STRETCHES_AT_ONCE]  # longest first
        first, longer = begin[own], len(own) - np.cumsum(np.bincount(n[own], minlength=1))
        sums = np.zeros((len(own), table.shape[1]), table.dtype)
        for i, k in enumerate(longer[:-1].tolist()):
            sums[:k] += table.take(at[first[:k] + i], axis=0)
        out[own] = sums
    return out


@dataclass
class Space:
    """The latent space: where a feature's word is, times its weight. ``feature`` has that of every term."""

    feature: np.ndarray
    basis: np.ndarray

    def features(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, self.feature[np.maximum(ids, 0)], -1 - ids) if len(self.feature) else -1 - ids

    def sums(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of stretches of words."""
        return row_sums(self.basis, self.features(ids), begin, end)


@dataclass
class Index:
    """A block of items: their words and answers as places among the terms, and the terms' weights."""

    items: list
    words: list[list[int]]
    answers: list[list[int]]
    idf: np.ndarray
    places: np.ndarray | None = None
    item_type: pa.DataType | None = None

    @property
    def lengths(self) -> np.ndarray:
        return np.array([len(w) for w in self.words])

    def shares(self, some: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each term's row (-1 for none, and last for words that are no terms), and what a row's term weighs in each of ``some`` items."""
        used = np.unique(np.concatenate([self.words[k] for k in some]))
        row = np.full(len(self.idf) + 1, -1, np.int32)
        row[used] = np.arange(len(used))
        gain = np.zeros((len(used), len(some)))
        for i, k in enumerate(some):
            np.add.at(gain[:, i], row[self.words[k]], weights[self.words[k]])
        return row, (gain / gain.sum(axis=0)).astype(np.float32)


def subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of bits at a time; negative words match nothing."""
    at = _bits(a)
    return _in_order([at[w] for w in b if w >= 0 and w in at], len(a))


def _bits(words: list[int]) -> dict[int, int]:
    """Where each word stands, as bits."""
    at: dict[int, int] = {}
    for i, w in enumerate(words):
        at[w] = at.get(w, 0) | 1 << i
    return at


def _in_order(bits: list[int], n: int) -> int:
    """Length of the longest common subsequence of ``n`` words and those that stand where ``bits`` say."""
    full = (1 << n) - 1
    row = full
    for b in bits:
        hit = row & b
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def _numbered(column: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of some kept texts, and each text's first."""
    offsets = column.offsets.to_numpy().astype(np.int64)[low : high + 1]
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of kept texts of about WORDS_AT_ONCE words."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + WORDS_AT_ONCE, side="right")) - 1)
        yield low, min(high, len(column))
        low = high


def _passages(first: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of the windows of all texts."""
    n = np.diff(first)
    own = -(-n // step)
    text = np.repeat(np.arange(len(n)), own)
    begin = first[:-1][text] + (np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)) * step
    return begin, np.minimum(begin + width, first[1:][text]), text


@dataclass
class _Lengths:
    """Items of about one length: how far a stretch with one may reach, and what their terms give."""

    room: int
    items: np.ndarray
    row: np.ndarray
    weights: np.ndarray
    counts: np.ndarray
    most: np.ndarray


def _by_length(index: Index) -> list[_Lengths]:
    """Items by length to the next power of two; of each term its share of every item's weight and of its words."""
    rooms = np.array([2 * max(LEAST_ROOM, 1 << (len(w) - 1).bit_length()) for w in index.words])
    out = []
    for room in np.unique(rooms).tolist():
        some = np.flatnonzero(rooms == room)
        row, weights = index.shares(some, index.idf**2)
        _, counts = index.shares(some, np.ones(len(index.idf)))
        most = np.zeros((len(weights) + 1, 2))
        most[:-1] = np.stack([weights.max(axis=1), counts.max(axis=1)], axis=1)
        out.append(_Lengths(room, some, row, weights, counts, most))
    return out


@dataclass
class _Terms:
    """Those words of some texts that have a row in a block: where they are, their rows, and where each occurred last."""

    at: np.ndarray
    rows: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, row: np.ndarray, ids: np.ndarray, before: np.ndarray) -> _Terms:
        rows = row[np.maximum(ids, -1)]
        at = np.flatnonzero(rows >= 0)
        return cls(at, rows[at], before[at])

    def within(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different terms of each stretch of words: the stretch and the row of each."""
        low, high = np.searchsorted(self.at, begin), np.searchsorted(self.at, end)
        n = high - low
        where = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        some = np.flatnonzero(self.before[where] < np.repeat(begin, n))
        return np.repeat(np.arange(len(n)), n)[some], self.rows[where[some]]


def _given(terms: _Terms, begin: np.ndarray, end: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``gain`` over the different terms of each window."""
    out = np.zeros((len(begin), gain.shape[1]), np.float32)
    step = max(1, WORDS_MULTIPLIED // int((end - begin).max(initial=1)))
    for low in range(0, len(begin), step):
        who, rows = terms.within(begin[low : low + step], end[low : low + step])
        cuts = np.searchsorted(who, np.arange(len(begin[low : low + step]) + 1))
        out[low : low + step] = row_sums(gain, rows, cuts[:-1], cuts[1:])
    return out


def _before(ids: np.ndarray) -> np.ndarray:
    """Where each term occurred last, or -1; it is not told for words that are no terms."""
    told = np.flatnonzero(ids >= 0)
    terms = ids[told]
    order = np.argsort(terms.astype(np.uint16) if terms.max(initial=0) < 1 << 16 else terms, kind="stable")
    before = np.full(len(ids), -1, np.int64)
    again = terms[order[1:]] == terms[order[:-1]]
    before[told[order[1:][again]]] = told[order[:-1][again]]
    return before


def _windows(lengths: _Lengths, ids: np.ndarray, before: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Text, item, begin and end of all windows with enough of an item's words and weight, in whatever order.

    Windows overlap by half. What their different terms give at most is summed by
    halves: a word counts in a window that begins with its half, or with the half
    before, if it occurred last before that.
    """
    terms = _Terms.of(lengths.row, ids, before)
    begin, end, text = _passages(first, 2 * lengths.room, lengths.room)
    if not len(begin):
        return
    middle = np.minimum(begin + lengths.room, end)
    low, half, high = (np.searchsorted(terms.at, at) for at in (begin, middle, end))
    in_first = terms.before < np.repeat(begin, half - low)
    in_second = terms.before < np.repeat(np.append(begin[:1], begin[:-1]), half - low)
    slack = 1 - 1e-4
    some = np.ones(len(begin), bool)
    for column, least in ((0, COSINE * COSINE), (1, WITH_ANSWER)):
        most = lengths.most[:, column][terms.rows]
        ones, twos = (np.concatenate([[0.0], np.cumsum(most * where)]) for where in (in_first, in_second))
        some &= ones[half] - ones[low] + twos[high] - twos[half] >= least * slack
    begin, end, text = begin[some], end[some], text[some]
    for at in range(0, len(begin), WINDOWS_AT_ONCE):
        a, b, t = begin[at : at + WINDOWS_AT_ONCE], end[at : at + WINDOWS_AT_ONCE], text[at : at + WINDOWS_AT_ONCE]
        heavy = _given(terms, a, b, lengths.weights) >= COSINE * COSINE * slack
        some = np.flatnonzero(heavy.any(axis=1))
        many = _given(terms, a[some], b[some], lengths.counts) >= WITH_ANSWER * slack
        for w, k in zip(*np.nonzero(heavy[some] & many), strict=True):
            yield int(t[some[w]]), int(lengths.items[k]), int(a[some[w]]), int(b[some[w]])


def _stretch(index: Index, k: int, around: list[int]) -> tuple | None:
    """Of a window's words those within twice the item's length with the most of it in order: share, cosine, answered, begin, end.

    The cosine is that of the item and those of its words that the stretch has.
    """
    item = index.words[k]
    least, room = WITH_ANSWER * len(item), 2 * len(item)
    own = _bits(item)
    at = [i for i, w in enumerate(around) if w in own]
    held = [own[around[i]] for i in at]  # other words are in no common subsequence
    if _in_order(held, len(item)) < least:
        return None
    answered = subsequence(index.answers[k], around) == len(index.answers[k])
    weight = lambda words: sum(n * float(index.idf[w]) ** 2 for w, n in words.items())
    enough = WITH_ANSWER if answered else SUBSEQUENCE
    whole = Counter(item)
    best, found = 0, None
    for j, i in enumerate(at):
        stop = bisect_left(at, i + room)
        if stop - j <= best or (stop - j) / len(item) < enough:
            continue
        n = _in_order(held[j:stop], len(item))
        if n <= best or n / len(item) < enough:
            continue
        end = at[stop - 1] + 1
        cosine = math.sqrt(weight(whole & Counter(around[i:end])) / weight(whole))
        if cosine >= COSINE:
            best, found = n, (n / len(item), min(1.0, cosine), answered, i, end)
    return found


def _confirmed(index: Index, k: int, around: list[int]) -> tuple | None:
    """Checks the words around a window against an item's: the share of it in order, and whether the answer is there."""
    item = index.words[k]
    share = subsequence(item, around) / len(item)
    if share < WITH_ANSWER:
        return None
    answered = subsequence(index.answers[k], around) == len(index.answers[k])
    return (share, answered) if share >= SUBSEQUENCE or answered else None


def near_windows(space: Space, places: np.ndarray, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, item, begin, end and cosine of all windows near an item in the latent space, many at a time."""
    begin, end, text = _passages(first, STEP, STEP)
    if not len(begin):
        return
    sums = space.sums(ids, begin, end)
    last = np.searchsorted(text, text, side="right")
    width = 1
    while width < WINDOWS[-1]:  # sums of twice as many steps, as far as the text goes
        more = np.flatnonzero(np.arange(len(begin)) + width < last)
        sums[more] += sums[more + width]
        width *= 2
        if width not in WINDOWS:
            continue
        stop = np.minimum(np.arange(len(begin)) + width, last)
        norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", sums, sums)), 1e-9)
        for at in range(0, len(begin), WINDOWS_AT_ONCE):
            cosines = sums[at : at + WINDOWS_AT_ONCE] @ places.T
            least = LATENT * norm[at : at + WINDOWS_AT_ONCE]
            near = np.flatnonzero(cosines.max(axis=1) >= least)
            w, k = np.nonzero(cosines[near] >= least[near, None])
            w = at + near[w]
            yield text[w], k, begin[w], end[stop[w] - 1], np.minimum(cosines[w - at, k] / norm[w], 1.0)


def _surroundings(index: Index, first: np.ndarray, text: np.ndarray, k: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words around a window begin and end among which an item is looked for: half its length more on either side."""
    n = index.lengths[k]
    return np.maximum(first[text], begin - n // 2), np.minimum(first[text + 1], np.maximum(end, begin + n) + n // 2)


def _holding(terms: _Terms, gain: np.ndarray, k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What share of their item's words stretches have, in whatever order."""
    out = np.zeros(len(k))
    for at in range(0, len(k), PAIRS_AT_ONCE):
        item = k[at : at + PAIRS_AT_ONCE]
        who, rows = terms.within(low[at : at + PAIRS_AT_ONCE], high[at : at + PAIRS_AT_ONCE])
        out[at : at + PAIRS_AT_ONCE] = np.bincount(who, weights=gain.ravel().take(rows * gain.shape[1] + item[who]), minlength=len(item))
    return out


def _may_hold(terms: _Terms, gain: np.ndarray, text: np.ndarray, k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Stretches near which there is enough of their item: those of a text and item that begin in the same WORDS_JOINED words are looked at as one."""
    if not len(k):
        return np.zeros(0, np.int64)
    order = np.lexsort((low, text, k))
    k, text, low, high = k[order], text[order], low[order], high[order]
    new = np.append(True, (np.diff(k) != 0) | (np.diff(text) != 0) | (np.diff(low // WORDS_JOINED) != 0))
    cuts = np.flatnonzero(new)
    some = _holding(terms, gain, k[cuts], low[cuts], np.maximum.reduceat(high, cuts)) >= WITH_ANSWER * (1 - 2e-4)
    return np.sort(order[some[np.cumsum(new) - 1]])


def decompose(texts: DataFrame, items: list[np.ndarray], idf: np.ndarray, feature: np.ndarray) -> Space:
    """The right singular vectors of the TF-IDF matrix of all passages of ``texts`` and the items.

    A random test matrix goes through the matrix and back in every partition,
    in one pass over the texts; the sums come together by blocks of features,
    the last of which has the passages' mean. From what comes back (Y = G T for
    the test matrix T and the matrix G of products of features) the driver takes
    Nystroem's approximation of G, Y (T'Y)^-1 Y', and its eigenvectors. All these
    have FEATURES and about RANK rows or columns, whatever the corpus. A direction
    with more than COMMON of its energy in the passages' mean is left out.
    """
    rank = RANK + OVERSAMPLED
    test = np.random.default_rng(SEED).standard_normal((FEATURES, rank)).astype(np.float32)
    sc = texts.sparkSession.sparkContext

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = test_of.value
        total, times, n = np.zeros((FEATURES, rank)), np.zeros(FEATURES), 0
        for batch in batches:
            for low, high in _pieces(batch.column(0)):
                ids, first = _numbered(batch.column(0), low, high)
                begin, end, _ = _passages(first, PASSAGE, PASSAGE)
                if not len(begin):
                    continue
                features, who, placed = space.features(ids), np.repeat(np.arange(len(begin)), end - begin), space.sums(ids, begin, end)
                order = np.argsort(features.astype(np.uint16), kind="stable")
                own = np.bincount(features, minlength=FEATURES)
                last = np.cumsum(own)
                total += row_sums(placed, who[order], last - own, last)
                times += own
                n += len(begin)
        if n:
            level = pa.array([TaskContext.get().partitionId() // LEVEL])
            for low in range(0, FEATURES, FEATURES_A_ROW):
                yield pa.RecordBatch.from_arrays([level, pa.array([low]), pa.array([total[low : low + FEATURES_A_ROW].tobytes()], pa.binary())], ["level", "at", "part"])
            yield pa.RecordBatch.from_arrays([level, pa.array([FEATURES]), pa.array([np.append(times, n).tobytes()], pa.binary())], ["level", "at", "part"])

    def added(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in parts.column("part"))
        return pa.table({"level": parts.column("level")[:1], "at": parts.column("at")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    test_of = sc.broadcast(Space(feature, test * idf[:, None].astype(np.float32)))
    y, mean = np.zeros((FEATURES, rank)), np.zeros(FEATURES)
    n = 0.0
    schema = "level long, at long, part binary"
    parts = texts.mapInArrow(sketch, schema).groupBy("level", "at").applyInArrow(added, schema)  # LEVEL tasks at a time, then all
    for p in parts.groupBy("at").applyInArrow(added, schema).collect():  # FEATURES rows in all
        part = np.frombuffer(p.part)
        if p.at == FEATURES:
            mean, n = part[:-1] * idf, part[-1]
        else:
            y[p.at : p.at + FEATURES_A_ROW] = part.reshape(-1, rank) * idf[p.at : p.at + FEATURES_A_ROW, None]
    for low in range(0, len(items), ITEMS_A_BLOCK):
        own = np.zeros((len(items[low : low + ITEMS_A_BLOCK]), FEATURES))
        for k, features in enumerate(items[low : low + ITEMS_A_BLOCK]):
            np.add.at(own[k], features, idf[features])
        y += own.T @ (own @ test)
    # Y T'Y's inverse square root: its left singular vectors are those of the approximation, its singular values their energies' roots.
    inner = test.astype(np.float64).T @ y
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    some = values > 1e-7 * max(values.max(), 1e-30)
    left, root, _ = np.linalg.svd(y @ (turn[:, some] / np.sqrt(values[some])), full_matrices=False)
    basis, energy = np.zeros((FEATURES, RANK)), np.zeros(RANK)
    found = min(RANK, len(root))
    basis[:, :found], energy[:found] = left[:, :found], root[:found] ** 2
    basis[:, (mean @ basis) ** 2 / max(1.0, n) > COMMON * energy] = 0  # what passages have in common, as their language, tells them not apart
    return Space(feature, (basis * idf[:, None]).astype(np.float32))


def _searched(batches: Iterator[pa.RecordBatch], blocks: list[Index], space: Space) -> Iterator[pa.RecordBatch]:
    """Confirmed matches of every row with every item, the best window of each."""
    names = ["doc", "item", "first_word", "last_word", "cosine", "subsequence", "answered"]
    by_length = [_by_length(index) for index in blocks]
    of_all = [index.shares(np.arange(len(index.words)), np.ones(len(index.idf))) for index in blocks]
    for batch in batches:
        for low, high in _pieces(batch.column(1)):
            ids, first = _numbered(batch.column(1), low, high)
            before = _before(ids)
            for index, lengths_of, (row, gain) in zip(blocks, by_length, of_all, strict=True):
                best: dict[tuple[int, int], tuple] = {}
                terms = _Terms.of(row, ids, before)
                for text, item, begin, end, cosine in near_windows(space, index.places, ids, first):
                    a, b = _surroundings(index, first, text, item, begin, end)
                    some = _may_hold(terms, gain, text, item, a, b)
                    text, item, a, b, begin, end, cosine = (v[some] for v in (text, item, a, b, begin, end, cosine))
                    held = _holding(terms, gain, item, a, b)
                    some = np.flatnonzero(held >= WITH_ANSWER * (1 - 1e-4))
                    for t, k, x, y, begin, end, c, most in zip(*(v[some].tolist() for v in (text, item, a, b, begin - first[text], end - first[text], cosine, held)), strict=True):
                        around = ids[x:y].tolist()
                        if most < SUBSEQUENCE * (1 - 1e-4) and not set(index.answers[k]) <= set(around):
                            continue
                        found = _confirmed(index, k, around)
                        found = found and (found[0], c, found[1], begin, end)
                        if found and ((t, k) not in best or found > best[t, k]):
                            best[t, k] = found
                for lengths in lengths_of:
                    for t, k, begin, end in _windows(lengths, ids, before, first):
                        found = _stretch(index, k, ids[begin:end].tolist())
                        if found:
                            origin = begin - int(first[t])
                            found = (*found[:3], found[3] + origin, found[4] + origin)
                            if (t, k) not in best or found > best[t, k]:
                                best[t, k] = found
                rows = sorted(best.items())
                columns = [batch.column(0)[low:high].take(pa.array([t for (t, _), _ in rows], pa.int64())), pa.array([index.items[k] for (_, k), _ in rows], index.item_type)]
                values = [[f[i] for _, f in rows] for i in (3, 4, 1, 0, 2)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(columns + [pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", answer: str | None = None, least_words: int = LEAST_WORDS
) -> DataFrame:
    """A row for each row of ``docs`` and item that it holds: ``key``, ``item``, first_word, last_word, cosine, subsequence, answered.

    Words lie between ASCII white space and are compared without case and signs. An item's answer is its column
    ``answer`` or else its last words. Items of fewer than ``least_words`` words
    say too little and are left out, as are null ones; with a lower number they
    are searched for like others. Null and empty texts hold nothing. Repeated
    rows are reported each, equal items each. Word positions leave out signs that
    stand alone. Frequencies and the decomposition cover all documents and items. A
    benchmark of more than ``GROUP_BYTES`` bytes is searched for in groups of
    about that size, for each of which the texts are read anew.
    """
    answers = F.col(answer) if answer else F.lit(None).cast("string")
    chosen = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text"), answers.cast("string").alias("answer"))
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-size // GROUP_BYTES))
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"))
    kinds = rows.schema["doc"].dataType.simpleString(), chosen.schema["item"].dataType.simpleString()
    schema = f"doc {kinds[0]}, item {kinds[1]}, first_word long, last_word long, cosine double, subsequence double, answered boolean"
    found = docs.sparkSession.createDataFrame([], schema)
    for k in range(groups):
        group = chosen.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == k)
        part = _of_group(rows, group, schema, least_words)
        if part is not None:
            found = part if k == 0 else found.unionByName(part)
    return found.withColumnsRenamed({"doc": key, "item": item})


def _of_group(rows: DataFrame, group: DataFrame, schema: str, least_words: int) -> DataFrame | None:
    sc = rows.sparkSession.sparkContext
    items = sorted(group.collect(), key=lambda r: (str(r.item), r.text))  # about GROUP_BYTES
    names, first = hashed([r.text.encode() for r in items])
    usable = [k for k in range(len(items)) if first[k + 1] - first[k] >= least_words]
    if not usable:
        return None
    terms = np.unique(np.concatenate([names[first[k] : first[k + 1]] for k in usable]))
    sent_terms = sc.broadcast(terms)
    feature = feature_of(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent_terms.value
        starts = starts_of(own)
        size = len(own) + FEATURES
        seen, docs = np.zeros(size, np.int64), 0
        for batch in batches:
            key_type = batch.schema.field(0).type
            for low, high in chunks(batch.column(1)):
                words, begin = hashed(batch.column(1)[low:high].to_pylist())
                ids = numbered(words, own, starts)
                who = np.repeat(np.arange(high - low), np.diff(begin)) * size
                for ways in (who[ids >= 0] + ids[ids >= 0], who + len(own) + feature_of(words)):
                    ways.sort()
                    seen += np.bincount(ways[np.flatnonzero(np.diff(ways, prepend=-1))] % size, minlength=size)
                docs += high - low
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], lists, pa.nulls(high - low, pa.int64()), pa.nulls(high - low, pa.int64())], ["doc", "ids", "term", "docs"])
        if docs:
            some = np.append(np.flatnonzero(seen), DOCS)
            nothing = [pa.nulls(len(some), key_type), pa.nulls(len(some), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(some), pa.array(np.append(seen, docs)[some])], ["doc", "ids", "term", "docs"])

    kind = rows.schema["doc"].dataType.simpleString()
    kept = keep(rows.mapInArrow(counted, f"doc {kind}, ids array<int>, term long, docs long"), "benchmark-terms")
    total, df = 0, np.zeros(len(terms) + FEATURES)
    for r in kept.where("docs is not null").groupBy("term").agg(F.sum("docs").alias("docs")).collect():  # one for each term and feature
        if r.term == DOCS:
            total = r.docs
        else:
            df[r.term] = r.docs
    idf = np.log((2.0 + total) / (1.0 + df))
    texts = kept.where("docs is null").select("doc", "ids")
    of_item = {k: np.searchsorted(terms, names[first[k] : first[k + 1]]) for k in usable}
    space = decompose(texts.select("ids"), [feature[of_item[k]] for k in usable], idf[len(terms) :], feature)
    blocks = []
    for low in range(0, len(usable), ITEMS_A_BLOCK):
        block = usable[low : low + ITEMS_A_BLOCK]
        words = [of_item[k].tolist() for k in block]
        told, at = hashed([(items[k].answer or "").encode() for k in block])
        told = numbered(told, terms).tolist()
        answers = [told[at[i] : at[i + 1]] or words[i][-ANSWER_WORDS:] for i in range(len(block))]
        ids, ends = np.concatenate([of_item[k] for k in block]), np.cumsum([len(w) for w in words])
        places = space.sums(ids, ends - [len(w) for w in words], ends)
        places /= np.maximum(np.sqrt((places * places).sum(axis=1, keepdims=True)), 1e-9)
        blocks.append(Index([items[k].item for k in block], words, answers, idf[: len(terms)], places, group.limit(0).toArrow().schema.field(0).type))
    sent = sc.broadcast((blocks, space))
    return texts.mapInArrow(lambda batches: _searched(batches, *sent.value), schema)
