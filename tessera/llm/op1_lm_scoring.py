"""Scores of a log-bilinear model trained with noise-contrastive estimation.

The most frequent words have vectors of their own, as targets and as contexts;
they are dealt in order of frequency to classes of ``CLASS_WORDS``. All other
words share ``SHARED`` classes by their last two bytes. The vectors of the
``CONTEXT`` tokens before a token, each through the matrix of its place, add up
to a prediction; its products with the vectors of all classes, and with those of
the words of the token's class, give the class's and the word's probability.
Both softmaxes are taken whole, by batched matrix products, so probabilities are
normalised exactly over all outcomes. Within a shared class words have
discounted relative frequencies, and one share is left for unknown words.

Counts of words cover all training texts and stay in Spark. The vectors learn
from every training token once. Texts are dealt as codes, in pieces of ``PIECE``
tokens with those before them, by a hash of the row's key, the text and the
piece's number, to ``SHARE`` rounds and in each to groups of about ``GROUP``
tokens; each group runs noise-contrastive steps in numpy, with noise sampled by
frequency, from common parameters, which are averaged in two levels by slices
after each round. How pieces are dealt depends on the rows alone, not on how the
table is laid out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Words, chunks, mix, most_frequent, offsets_of
from tessera.llm.workspace import keep

END = np.uint64(0x5EED)  # the name of a text's end
VOCABULARY = 10_240
CLASS_WORDS = 104
SHARED = 16
HEAD = 1 << 18
CONTEXT = 3
WIDTH = 32
CLASS_NOISE = 64
WORD_NOISE = 16
SHARE = 3  # rounds, each on another one in SHARE of the tokens
PIECE = 1 << 10
LEAST_STEPS = 24
BATCH = 1 << 14
RATE = 0.1
SEEN = 1.0
SLICE = 1 << 14
WORDS_KEPT = 1 << 19
EXAMPLES_KEPT = 1 << 20
GROUP = 1 << 20
LEVEL = 64
TOKENS_AT_ONCE = 1 << 12  # rows of a product, so that it stays in a core's cache
TOKENS_TOGETHER = 1 << 16  # rows that are sorted by class together
SEED = 11


def shared_classes(words: Words) -> np.ndarray:
    """The numbers of the words' shared classes, by their last two bytes."""
    last = words.data[words.ends - 1].astype(np.uint64)
    before = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
    return (mix(last * np.uint64(256) + before) % np.uint64(SHARED)).astype(np.int32)


@dataclass
class Tokens:
    """The words of some texts and each text's end: names, shared classes, and the first token of every text."""

    names: np.ndarray
    shared: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(column: pa.Array, begin: int, end: int) -> Tokens:
        words = Words(column, begin, end)
        first = words.first + np.arange(end - begin + 1)
        is_word = np.ones(first[-1], bool)
        is_word[first[1:] - 1] = False
        names, shared = np.full(first[-1], END, np.uint64), np.zeros(first[-1], np.int32)
        names[is_word], shared[is_word] = words.hashes(), shared_classes(words)
        return Tokens(names, shared, first)


def _tokens(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    for batch in batches:
        for begin, end in chunks(batch.column(column)):
            yield batch.slice(begin, end - begin), Tokens.of(batch.column(column), begin, end)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their shared class and number, summed while they are few enough."""
    kept, total = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, shared, n = (np.concatenate(x) for x in zip(*kept, strict=True))
        names, at, place = np.unique(names, return_index=True, return_inverse=True)
        return names, shared[at], np.bincount(place, weights=n).astype(np.int64)

    def rows() -> pa.RecordBatch:
        names, shared, n = merged()
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(shared), pa.array(n)], ["word", "shared", "n"])

    for _, t in _tokens(batches, 0):
        names, at, n = np.unique(t.names, return_index=True, return_counts=True)
        kept.append((names, t.shared[at], n))
        total += len(names)
        if total > WORDS_KEPT:
            kept = [merged()]
            total = len(kept[0][0])
            if total > WORDS_KEPT // 2:
                yield rows()
                kept, total = [], 0
    if kept:
        yield rows()


class Head:
    """The most frequent words by falling frequency: how often, what share of a shared class, and quick to look up."""

    def __init__(self, names: np.ndarray, times: np.ndarray, shares: np.ndarray, own: int):
        self.names, self.times, self.shares, self.own = names, times, shares, own
        self.known = np.append(np.log10(times + 1.0), 0.0)
        self.order = np.argsort(names)
        self.table: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "table": None}

    def places(self, names: np.ndarray) -> np.ndarray:
        """Where words are in the list, or its length."""
        if self.table is None:
            self.table = np.zeros(1 << 21, np.int32)
            at = np.arange(len(self.names) - 1, -1, -1)
            self.table[(self.names[at] & np.uint64(len(self.table) - 1)).astype(np.int64)] = at  # the more frequent word wins
            self.sorted = self.names[self.order]
        if not len(self.names):
            return np.zeros(len(names), np.int32)
        found = self.table[(names & np.uint64(len(self.table) - 1)).astype(np.int64)]
        rest = np.flatnonzero(self.names[found] != names)
        at = np.minimum(np.searchsorted(self.sorted, names[rest]), len(self.sorted) - 1)
        found[rest] = np.where(self.sorted[at] == names[rest], self.order[at], len(self.names))
        return found

    def codes(self, t: Tokens, places: np.ndarray) -> np.ndarray:
        """A word's place if it has vectors of its own, else their number plus its shared class."""
        return np.where(places < self.own, places, self.own + t.shared)


def contexts(codes: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The CONTEXT codes before every token, the nearest first; ``start`` stands before a text."""
    n = np.arange(len(codes)) - np.repeat(first[:-1], np.diff(first))
    out = np.full((len(codes), CONTEXT), start, np.int32)
    for k in range(CONTEXT):
        some = np.flatnonzero(n > k)
        out[some, k] = codes[some - k - 1]
    return out


def scatter(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ``rows``, and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    cuts = np.flatnonzero(np.diff(rows[order].astype(np.int64), prepend=-1))
    return rows[order[cuts]].astype(np.int64), np.add.reduceat(values.take(order, axis=0), cuts, axis=0)


def _sigmoid_of_minus(x: np.ndarray) -> np.ndarray:
    """The sigmoid of ``-x`` in the place of ``x``."""
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _with_ones(r: np.ndarray) -> np.ndarray:
    return np.concatenate([r, np.ones((len(r), 1), np.float32)], axis=1)


def _weighted(vectors: np.ndarray, biases: np.ndarray) -> np.ndarray:
    """What rows that end with a one are multiplied by to get products with the vectors, plus their biases."""
    return np.concatenate([vectors, biases[:, None]], axis=1).T.copy()


def _blocks(begin: int, end: int) -> Iterator[tuple[int, int]]:
    return ((low, min(low + TOKENS_AT_ONCE, end)) for low in range(begin, end, TOKENS_AT_ONCE))


def _log_softmax(z: np.ndarray, chosen: np.ndarray, wide: bool) -> np.ndarray:
    """Logarithms of the chosen outcomes' shares of each row; ``z`` is used up. ``wide`` says that it may be too large for exponentials."""
    of_chosen = z.ravel().take(np.arange(0, z.size, z.shape[1]) + chosen).astype(np.float64)
    if wide:
        top = z.max(axis=1)
        z -= top[:, None]
        of_chosen -= top
    np.exp(z, out=z)
    return of_chosen - np.log(z @ np.ones(z.shape[1], np.float32))


class Model:
    """Parameters of the log-bilinear model over ``own`` words and the shared classes.

    ``counts`` are those of all codes in training, with one added.
    """

    def __init__(self, counts: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.own = len(counts) - SHARED
        self.blocks = -(-self.own // CLASS_WORDS)
        self.start = len(counts)
        codes = np.arange(len(counts))
        self.class_of = np.where(codes < self.own, codes // CLASS_WORDS, self.blocks + codes - self.own)
        self.class_share = np.bincount(self.class_of, weights=counts) / counts.sum()
        self.upto = np.concatenate([[0.0], np.cumsum(counts[: self.own])])
        lows = np.minimum(np.arange(self.blocks + 1) * CLASS_WORDS, self.own)
        self.mass = self.upto[lows]
        of_class = np.diff(self.mass)[self.class_of[: self.own]]
        self.word_share = counts[: self.own] / of_class
        self.seen: list[np.ndarray] | None = None
        self.placed: list[np.ndarray] | None = None  # contexts through the matrices of their places
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.parts = [
            small(len(counts) + 1, WIDTH),  # contexts, the start last
            np.stack([np.eye(WIDTH, dtype=np.float32) * 0.6**k for k in range(CONTEXT)]),
            small(len(self.class_share), WIDTH), np.log(self.class_share).astype(np.float32),
            small(self.own, WIDTH), np.log(self.word_share).astype(np.float32),
        ]

    def packed(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        self.placed = None
        for k, p in enumerate(self.parts):
            self.parts[k] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size

    def predicted(self, context: np.ndarray) -> np.ndarray:
        embed, places = self.parts[:2]
        return sum(embed[context[:, k]] @ places[k] for k in range(CONTEXT))

    def log_probabilities(self, context: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of ``codes``, normalised over all classes and all words of a class."""
        embed, places, of_class, class_bias, of_word, word_bias = self.parts
        if self.placed is None:
            self.placed = [embed @ places[k] for k in range(CONTEXT)]
            self.reach = max(float(np.sqrt((x * x).sum(axis=1).max(initial=0.0))) for x in (of_class, of_word))
            self.offset = max(float(np.abs(x).max(initial=0.0)) for x in (class_bias, word_bias))
            lows = [c * CLASS_WORDS for c in range(self.blocks)]
            self.weights = [_weighted(of_class, class_bias), *(_weighted(of_word[a : a + CLASS_WORDS], word_bias[a : a + CLASS_WORDS]) for a in lows)]
        r = self.placed[0].take(context[:, 0], axis=0)
        for k in range(1, CONTEXT):
            r += self.placed[k].take(context[:, k], axis=0)
        cls = self.class_of[codes]
        longest = float(np.sqrt(np.einsum("ij,ij->i", r, r).max(initial=0.0)))
        wide = longest * self.reach + self.offset > 60
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        r, own, sorted_cls = _with_ones(r.take(order, axis=0)), codes[order], cls[order]
        room = np.empty(min(TOKENS_AT_ONCE, len(r)) * max((w.shape[1] for w in self.weights), default=0), np.float32)
        found = np.empty(len(r))

        def told(a: int, b: int, weights: np.ndarray, chosen: np.ndarray) -> np.ndarray:
            z = room[: (b - a) * weights.shape[1]].reshape(b - a, weights.shape[1])
            return _log_softmax(np.matmul(r[a:b], weights, out=z), chosen, wide)

        for a, b in _blocks(0, len(r)):
            found[a:b] = told(a, b, self.weights[0], sorted_cls[a:b])
        cuts = np.searchsorted(sorted_cls, np.arange(self.blocks + 1))
        for c in np.flatnonzero(np.diff(cuts)):
            for a, b in _blocks(cuts[c], cuts[c + 1]):
                found[a:b] += told(a, b, self.weights[1 + c], own[a:b] - c * CLASS_WORDS)
        out = np.empty(len(r))
        out[order] = found
        return out

    def gradients(self, context: np.ndarray, codes: np.ndarray, rng: np.random.Generator) -> list[tuple]:
        """Of the noise-contrastive objective, for each part: rows and their gradients, ``...`` for all rows.

        Examples go in order of their codes, so that those of a class stand together and share its noise.
        """
        embed, places, of_class, class_bias, of_word, word_bias = self.parts
        order = np.argsort(codes.astype(np.uint16), kind="stable")
        codes, context = codes[order], context[order]
        near = [embed.take(context[:, k], axis=0) for k in range(CONTEXT)]
        r = near[0] @ places[0]
        for k in range(1, CONTEXT):
            r += near[k] @ places[k]
        r = _with_ones(r)
        cls = self.class_of[codes]
        noise = rng.choice(len(self.class_share), CLASS_NOISE, p=self.class_share)
        ask = np.log(CLASS_NOISE * self.class_share).astype(np.float32)
        # A vector's last component is its bias, a row's a one.
        classes = np.concatenate([of_class, (class_bias - ask)[:, None]], axis=1)
        drawn_classes = classes[noise]
        against = -drawn_classes.T
        of_true = classes.take(cls, axis=0)
        true = 1 - _sigmoid_of_minus(-np.einsum("nd,nd->n", r, of_true))
        of_true *= true[:, None]
        dr = of_true  # its last column is of no use
        of_noise = np.zeros((CLASS_NOISE, WIDTH + 1), np.float32)
        room = np.empty((min(TOKENS_AT_ONCE, len(r)), CLASS_NOISE), np.float32)
        for a, b in _blocks(0, len(r)):
            false = _sigmoid_of_minus(np.matmul(r[a:b], against, out=room[: b - a]))
            dr[a:b] -= false @ drawn_classes
            of_noise -= false.T @ r[a:b]
        cuts = np.flatnonzero(np.diff(cls, prepend=-1))
        told = np.add.reduceat(true[:, None] * r, cuts, axis=0)
        rows, values = scatter(np.concatenate([cls[cuts], noise]), np.concatenate([told, of_noise]))
        out = [None, None, (rows, values[:, :-1]), (rows, values[:, -1])]
        own = int(np.searchsorted(codes, self.own))
        if own:
            w, rw, c = codes[:own], r[:own], cls[:own]
            ends = np.append(np.flatnonzero(np.diff(c)) + 1, own)
            met = c[ends - 1]
            u = self.mass[met][:, None] + rng.random((len(met), WORD_NOISE)) * np.diff(self.mass)[met][:, None]
            drawn = np.minimum(np.searchsorted(self.upto, u.ravel(), side="right") - 1, self.own - 1).reshape(u.shape)
            words = np.concatenate([of_word, (word_bias - np.log(WORD_NOISE * self.word_share).astype(np.float32))[:, None]], axis=1)
            of_true = words.take(w, axis=0)
            true = 1 - _sigmoid_of_minus(-np.einsum("nd,nd->n", rw, of_true))
            of_true *= true[:, None]
            dr[:own] += of_true
            vectors = words[drawn]
            against = np.ascontiguousarray(-vectors.transpose(0, 2, 1))
            runs = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
            false = np.empty((own, WORD_NOISE), np.float32)
            for i, (a, b) in enumerate(runs):
                np.matmul(rw[a:b], against[i], out=false[a:b])
            np.negative(_sigmoid_of_minus(false), out=false)
            of_noise = np.empty((*drawn.shape, WIDTH + 1), np.float32)
            for i, (a, b) in enumerate(runs):
                dr[a:b] += false[a:b] @ vectors[i]
                np.matmul(false[a:b].T, rw[a:b], out=of_noise[i])
            cuts = np.flatnonzero(np.diff(w, prepend=-1))
            told = np.add.reduceat(true[:, None] * rw, cuts, axis=0)
            rows, values = scatter(np.concatenate([w[cuts], drawn.ravel()]), np.concatenate([told, of_noise.reshape(-1, WIDTH + 1)]))
            out += [(rows, values[:, :-1]), (rows, values[:, -1])]
        else:
            out += [(codes[:0], of_word[:0]), (codes[:0], word_bias[:0])]
        dr = np.ascontiguousarray(dr[:, :-1])
        back = np.zeros_like(embed)
        for k in range(CONTEXT):
            rows, values = scatter(context[:, k].astype(np.uint16), dr)
            back[rows] += values @ places[k].T
        out[0] = (..., back)
        out[1] = (..., np.stack([near[k].T @ dr for k in range(CONTEXT)]))
        return out

    def stepped(self, examples: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        """A pass over ``examples`` (contexts, then the token), LEAST_STEPS steps at least.

        Every parameter's steps get smaller as its gradients add up, over all
        calls; a word met in one example hardly moves.
        """
        if self.seen is None:
            self.seen = [np.full(p.shape, SEEN, np.float32) for p in self.parts]
        steps = max(LEAST_STEPS, -(-len(examples) // BATCH))
        order = rng.permutation(len(examples))
        size = min(BATCH, len(examples))
        for step in range(steps):
            at = step * size % len(examples)
            some = examples[order[at : at + size]].astype(np.int64)
            for p, s, (rows, g) in zip(self.parts, self.seen, self.gradients(some[:, :CONTEXT], some[:, CONTEXT], rng), strict=True):
                s[rows] += g * g
                p[rows] += rate * g / np.sqrt(s[rows])
        self.placed = None


def train(pieces: DataFrame, counts: np.ndarray) -> Model:
    """Fits on the ``pieces`` of texts by group, in SHARE rounds, each on its own pieces; every round averages what the groups' own steps give, by slices of the parameters.

    Slices are added up for ``LEVEL`` groups at a time and then for all of them, so what
    meets in a task is the square root of what there is.
    """
    sc = pieces.sparkSession.sparkContext
    model = Model(counts)
    schema = "level long, number long, at long, part binary, weight double"
    for k in range(SHARE):
        sent = sc.broadcast((counts, model.packed()))
        own = pieces.where(F.col("round") == k).drop("round")
        parts = own.groupBy("group").applyInArrow(_round(sent, k), schema).groupBy("level", "at").applyInArrow(_added, schema)
        flat = sent.value[1].copy()
        for p in parts.groupBy("level", "at").applyInArrow(_added, schema).collect():  # one model
            flat[p.at : p.at + SLICE] = (np.frombuffer(p.part, np.float64) / p.weight).astype(np.float32)
        model.unpack(flat)
    return model


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(blob.as_buffer(), kind) for blob in column])


def _moved(sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where the entries of pieces of some sizes are if the pieces stand in ``order``."""
    s = sizes[order]
    return np.repeat((np.cumsum(sizes) - sizes)[order] - (np.cumsum(s) - s), s) + np.arange(s.sum())


def examples_of(group: pa.Table) -> np.ndarray:
    """The tokens of a group's pieces, each with the tokens before it, the nearest first; the same order however the pieces came."""
    lots, sizes, codes = _joined(group.column("lots"), np.uint64), _joined(group.column("sizes"), np.int32).astype(np.int64), _joined(group.column("codes"), np.uint16)
    order = np.argsort(lots, kind="stable")  # pieces of one lot are equal
    codes, sizes = codes[_moved(sizes, order)], sizes[order]
    is_token = np.ones(len(codes), bool)
    is_token[((np.cumsum(sizes) - sizes)[:, None] + np.arange(CONTEXT)).ravel()] = False
    at = np.flatnonzero(is_token)
    return np.column_stack([*(codes[at - k] for k in range(1, CONTEXT + 1)), codes[at]])


def _round(sent, k: int) -> Callable[[pa.Table], pa.Table]:
    """A group's own steps of round ``k``, from the parameters sent: its parameters times its examples, by slices."""

    def steps(group: pa.Table) -> pa.Table:
        own = Model(sent.value[0])
        own.unpack(sent.value[1])
        number = group.column("group")[0].as_py()
        found = examples_of(group)
        own.stepped(found, RATE / math.sqrt(1 + k), np.random.default_rng([SEED, k, number]))
        flat = own.packed()
        lows = range(0, len(flat), SLICE)
        parts = [(flat[low : low + SLICE].astype(np.float64) * len(found)).tobytes() for low in lows]
        n = len(parts)
        return pa.table({"level": pa.array([number // LEVEL] * n), "number": pa.array([number] * n), "at": pa.array(lows), "part": pa.array(parts, pa.binary()), "weight": pa.array([float(len(found))] * n)})

    return steps


def _added(parts: pa.Table) -> pa.Table:
    parts = parts.sort_by("number")
    total = sum(np.frombuffer(x.as_py(), np.float64) for x in parts.column("part"))
    return pa.table({"level": pa.array([0]), "number": parts.column("level")[:1], "at": parts.column("at")[:1], "part": pa.array([total.tobytes()], pa.binary()), "weight": pa.array([sum(parts.column("weight").to_pylist())])})


def _by_class(values: np.ndarray) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("shared") + 1)


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """``key``, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A row is held out if crc32 of its key as text leaves ``held`` on division by
    ``folds``; a null key is not held out. All other rows are learned from. A
    null text counts as empty; an empty text has one token, its end. Repeated
    rows count, and are scored, as often as they occur, alike up to the rounding
    of products in single precision. base_score is that of word frequencies with one added; score the log10 probability under the
    model. Words are told apart by 64-bit names. Other columns are left out; an
    empty table gives no rows, and without training texts every word is unknown.
    What tasks are sent is the list of about ``HEAD`` words and the parameters
    of ``VOCABULARY`` of them.
    """
    sc = docs.sparkSession.sparkContext
    fold = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))
    rows = docs.select(
        F.col(key).alias("doc"), F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content")
    )
    training = rows.where("not held_out").select("content", F.xxhash64("doc").alias("lot"))
    counts = training.mapInArrow(_counted, "word long, shared int, n long")
    counts = keep(counts.groupBy("word", "shared").agg(F.sum("n").alias("n")), "lm-words")
    tokens, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = counts.where(F.col("word") == int(END))
    listed = most_frequent(counts, "word", "n", HEAD).unionByName(end).distinct().toPandas()
    order = np.lexsort((listed["word"], -listed["n"], listed["word"] != int(END)))  # the end is always one of them
    names, times, shared = (listed[c].to_numpy()[order] for c in ("word", "n", "shared"))
    own = min(VOCABULARY, len(names))
    is_rare = F.col("word") != int(END)
    found = counts.groupBy("shared").agg(F.sum(F.when(is_rare, F.col("n"))), F.sum(is_rare.cast("long")), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).collect()
    of_class = np.zeros((4, SHARED))  # tokens, words, words that occur once, and twice
    for c, *values in found:
        of_class[:, c] = [v or 0 for v in values]
    for n, s, word in zip(times[:own], shared[:own], names[:own], strict=True):
        if word != int(END):
            of_class[:, s] -= [n, 1, n == 1, n == 2]
    sums, kinds, once, twice = of_class
    discount = np.where(kinds > 0, np.clip(once / np.maximum(1, once + 2 * twice), 0.05, 0.95), 0.0)
    unseen = np.where(kinds > 0, discount * kinds / np.maximum(sums, 1), 1.0)
    sums = np.where(kinds > 0, sums, 1.0)
    of_code = np.concatenate([times[:own], of_class[0]]) + 1.0
    shares = np.log10(np.maximum(times - discount[shared], 1e-9) / sums[shared])
    shares[:own] = 0.0
    head = sc.broadcast(Head(names.astype(np.int64).view(np.uint64), times, np.append(shares, 0.0), own))
    groups = max(1, -(-int(tokens) // (SHARE * GROUP)))
    pieces = keep(training.mapInArrow(lambda it: _pieces(it, head.value, groups), "group long, round int, lots binary, sizes binary, codes binary"), "lm-pieces")
    model = train(pieces, of_code)
    return _scored(rows, counts, head, (of_code, model.packed()), (tokens, words), (discount, sums, unseen)).withColumnRenamed("doc", key)


def _pieces(batches: Iterator[pa.RecordBatch], head: Head, groups: int) -> Iterator[pa.RecordBatch]:
    """All texts as codes, in pieces of PIECE tokens after the CONTEXT before them, by group and round; dealt by hash."""
    kept, total = [], 0

    def packed() -> pa.RecordBatch:
        lots, sizes, codes = (np.concatenate(x) for x in zip(*kept, strict=True))
        dealt = (mix(lots + np.uint64(SEED)) % np.uint64(groups)).astype(np.int64) * SHARE + (lots % np.uint64(SHARE)).astype(np.int64)
        order = np.argsort(dealt, kind="stable")
        codes, lots, sizes, dealt = codes[_moved(sizes, order)], lots[order], sizes[order], dealt[order]
        cuts = np.flatnonzero(np.diff(dealt, prepend=-1))
        ends = np.append(cuts[1:], len(dealt))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        sizes = sizes.astype(np.int32)
        blobs = [[lots[a:b].tobytes(), sizes[a:b].tobytes(), codes[upto[a] : upto[b]].tobytes()] for a, b in zip(cuts, ends, strict=True)]
        numbers = [pa.array(dealt[cuts] // SHARE), pa.array((dealt[cuts] % SHARE).astype(np.int32))]
        return pa.RecordBatch.from_arrays(numbers + [pa.array(x, pa.binary()) for x in zip(*blobs, strict=True)], ["group", "round", "lots", "sizes", "codes"])

    for part, t in _tokens(batches, 0):
        # A piece's hash is of its row's key, its text's words and its number.
        own = -(-np.diff(t.first) // PIECE)
        text = np.repeat(np.arange(len(own)), own)
        number = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        whole = np.add.reduceat(t.names, t.first[:-1]) + part.column(1).to_numpy().view(np.uint64)
        begin = t.first[:-1][text] + number * PIECE
        sizes = np.minimum(begin + PIECE, t.first[1:][text]) - begin + CONTEXT
        at = np.repeat(begin - CONTEXT - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        codes = head.codes(t, head.places(t.names))[np.maximum(at, 0)]
        codes[at < np.repeat(t.first[:-1][text], sizes)] = head.own + SHARED
        kept.append((mix(whole[text] + mix(number.astype(np.uint64))), sizes, codes.astype(np.uint16)))
        total += len(codes)
        if total > EXAMPLES_KEPT:
            yield packed()
            kept, total = [], 0
    if kept:
        yield packed()


_RARE = np.dtype([("row", "<i8"), ("times", "<i8")])


def _scored(rows: DataFrame, counts: DataFrame, head, fitted: tuple[np.ndarray, np.ndarray], size: tuple[int, int], shared: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Scores every row: words of the head list in tasks, others by a join of their names with the counts.

    A task sends each of its other words once, with the rows that have it.
    """
    tokens, words = size
    discount, sums, unseen = shared
    sent = rows.sparkSession.sparkContext.broadcast(fitted)
    kind = rows.schema["doc"].dataType.simpleString()
    names = ["row", "doc", "held_out", "n_tokens", "known", "base", "lp", "word", "shared", "places"]

    def rare(kept: list[tuple[np.ndarray, ...]], key_type: pa.DataType) -> pa.RecordBatch:
        word, s, row = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((row, word))
        word, s, row = word[order], s[order], row[order]
        new_word = np.diff(word, prepend=~word[:1]) != 0
        new = new_word | (np.diff(row, prepend=-1) != 0)
        at = np.flatnonzero(new)
        told = np.zeros(len(at), _RARE)
        told["row"], told["times"] = row[at], np.diff(np.append(at, len(word)))
        cuts = np.flatnonzero(new_word[at])
        ends = np.append(cuts[1:], len(at))
        sizes = pa.py_buffer(np.append(cuts[:1] * 0, ends * told.itemsize).astype(np.int32))
        blobs = pa.Array.from_buffers(pa.binary(), len(cuts), [None, sizes, pa.py_buffer(told)])
        nothing = [pa.nulls(len(cuts), t) for t in (pa.int64(), key_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([*nothing, pa.array(word[at[cuts]]), pa.array(s[at[cuts]], pa.int32()), blobs], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, model = head.value, Model(sent.value[0])
        model.unpack(sent.value[1])
        row = TaskContext.get().partitionId() << 40
        kept, total = [], 0
        for part, t in _tokens(batches, 2):
            n, places = len(part), h.places(t.names)
            codes = h.codes(t, places)
            context = contexts(codes, t.first, model.start)
            lp = h.shares[places]
            for low in range(0, len(codes), TOKENS_TOGETHER):
                some = slice(low, low + TOKENS_TOGETHER)
                lp[some] += model.log_probabilities(context[some], codes[some]) / math.log(10)
            add = lambda x, t=t: np.add.reduceat(x, t.first[:-1])
            ids = np.arange(row, row + n)
            row += n
            held = [pa.array(ids), part.column(0), part.column(1), pa.array(np.diff(t.first)), pa.array(add((places < len(h.names)).astype(np.int64))), pa.array(add(h.known[places])), pa.array(add(lp))]
            yield pa.RecordBatch.from_arrays([*held, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
            rest = np.flatnonzero(places == len(h.names))
            kept.append((t.names[rest].view(np.int64), t.shared[rest], ids[np.searchsorted(t.first, rest, side="right") - 1]))
            total += len(rest)
            if total > WORDS_KEPT:
                yield rare(kept, part.schema.field(0).type)
                kept, total = [], 0
        if total:
            yield rare(kept, part.schema.field(0).type)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ends = offsets_of(batch.column(3))
            told = np.frombuffer(batch.column(3).buffers()[2], np.uint8)[ends[0] : ends[-1]].view(_RARE)
            which = np.repeat(np.arange(len(batch)), np.diff(ends) // _RARE.itemsize)
            row, place = np.unique(told["row"], return_inverse=True)
            sums_of = [np.bincount(place, weights=batch.column(c).to_numpy(zero_copy_only=False)[which] * told["times"]) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(sums_of[0].astype(np.int64)), pa.array(sums_of[1]), pa.array(sums_of[2])], ["row", "known", "base", "lp"])

    schema = f"row long, doc {kind}, held_out boolean, n_tokens long, known long, base double, lp double, word long, shared int, places binary"
    parts = keep(rows.mapInArrow(run, schema), "lm-parts")
    others = parts.where("word is not null").select("word", "shared", "places").join(counts.select("word", F.col("n").alias("c")), "word", "left")
    of_known = F.log10((F.col("c") - _by_class(discount)) / _by_class(sums))
    of_unknown = _by_class(np.log10(unseen))
    others = others.select(
        F.col("c").isNotNull().cast("double").alias("known"), F.log10(F.coalesce("c", F.lit(0)) + 1).alias("base"), F.when(F.col("c").isNull(), of_unknown).otherwise(of_known).alias("lp"), "places"
    )
    others = others.mapInArrow(spread, "row long, known long, base double, lp double")
    whole = parts.where("word is null").select("row", "doc", "held_out", "n_tokens", "known", "base", "lp").unionByName(others, allowMissingColumns=True)
    whole = whole.groupBy("row").agg(
        F.max("doc").alias("doc"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("known").alias("n_known"), F.sum("base").alias("base"), F.sum("lp").alias("score"),
    )
    return whole.select(
        "doc", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(tokens + words + 1))).alias("base_score"), "score",
    )
