"""Ranked lexical search over an inverted index in shards, by MaxScore.

The index is a table: one row per shard and term with the documents that hold
the term and how often (a long list in rows of ``LIST``), and one row per shard,
with a null term, of the documents themselves and their lengths. A shard takes documents of one input
partition until it has ``SHARD_DOCS`` documents or ``SHARD_POSTINGS`` postings.

A search reads only the postings of its items' terms. Their frequencies, and the
numbers of documents and terms, are summed over all shards, so scores do not
depend on how documents are dealt. In a shard each term's greatest score is its
upper bound. An item's terms are taken in falling order of it; once the bounds
of those left add up to less than the item's k-th score, they are non-essential:
no document without one of the terms before can rank. They are then only probed,
for documents whose score and the bounds still left reach the k-th score. That
score is kept from shard to shard of a task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.workspace import keep

SHARD_DOCS = 1 << 15
SHARD_POSTINGS = 1 << 21
BLOCK_BYTES = 8 << 20
SPREAD = 64
LIST = 1024
ROWS = 4096
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Every byte that ends a term becomes a blank, A-Z become a-z; bytes of other letters stay.
_AS_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))


class _Shard:
    """Postings of a bounded number of documents, in the order in which they come."""

    def __init__(self) -> None:
        self.keys: list = []
        self.lengths: list[int] = []
        self.distinct: list[int] = []
        self.terms: list[bytes] = []
        self.times: list[int] = []

    def add(self, key: object, counts: Counter) -> None:
        self.keys.append(key)
        self.lengths.append(counts.total())
        self.distinct.append(len(counts))
        self.terms += counts.keys()
        self.times += counts.values()

    def full(self) -> bool:
        return len(self.keys) >= SHARD_DOCS or len(self.terms) >= SHARD_POSTINGS

    def batches(self, name: int, columns: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The row of documents, then those of the terms in order, a long list in rows of ``LIST`` documents."""
        first = [[name], [None], [None], [self.keys], [None], [self.lengths]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(first, columns, strict=True)], schema=columns)
        names = sorted(set(self.terms))
        number = dict(zip(names, range(len(names)), strict=True))
        of = np.fromiter(map(number.__getitem__, self.terms), np.int64, len(self.terms))
        order = np.argsort(of, kind="stable")
        docs = np.repeat(np.arange(len(self.keys), dtype=np.int32), self.distinct)[order]
        times = np.array(self.times, np.int64)[order]
        sizes = np.bincount(of, minlength=len(names))
        parts = -(-sizes // LIST)
        row_term = np.repeat(np.arange(len(names)), parts)
        nth = np.arange(len(row_term)) - np.repeat(np.cumsum(parts) - parts, parts)
        begins = (np.cumsum(sizes) - sizes)[row_term] + nth * LIST
        ends = np.append(begins[1:], len(docs))
        for at in range(0, len(row_term), ROWS):
            to = min(at + ROWS, len(row_term))
            n, low, high = to - at, begins[at], ends[to - 1]
            offsets = pa.array(np.append(begins[at:to], high) - low, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[low:high])) for x in (docs, times)]
            told = [pa.array(np.full(n, name)), pa.array([names[t] for t in row_term[at:to]], pa.binary()), pa.array(ends[at:to] - begins[at:to]), pa.nulls(n, columns.field("keys").type), *lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(told, columns, strict=True)], schema=columns)


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all rows of ``docs``: shard, term, df, keys, docs, times.

    Terms are the maximal runs of letters and digits (ASCII) and of any other
    characters beyond ASCII in the whole text, A-Z lower-cased, as UTF-8 bytes.
    Each row is a document: keys may repeat or be null. A text that is null or
    without terms has length 0. An empty table gives no rows.
    """
    kind = docs.select(F.col(key).alias("k")).schema["k"].dataType
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.BinaryType()), T.StructField("df", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("docs", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.LongType()))])

    columns = to_arrow_schema(schema)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[_Shard]:
        shard = _Shard()
        for batch in batches:
            for k, body in zip(batch.column(0), batch.column(1), strict=True):
                shard.add(k.as_py(), Counter((body.as_py() or b"").translate(_AS_TERMS).split()))
                if shard.full():
                    yield shard
                    shard = _Shard()
        if shard.keys:
            yield shard

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for n, shard in enumerate(shards(batches)):
            yield from shard.batches(first + n, columns)

    return docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("body")).mapInArrow(build, schema)


class _Query:
    """The items of a block: their terms by number, and each term's weight."""

    def __init__(self, names: list, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> None:
        self.names, self.items, self.weights = names, items, weights
        self.n_docs, self.n_terms, self.k = n_docs, n_terms, k

    def fade(self, length: int) -> int:
        """What a document's length adds to a frequency; exact, whatever the numbers."""
        return 100 - 50 + (50 * length * self.n_docs) // self.n_terms


class _Best:
    """The k best documents of each item so far: score, then key; null keys last."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.found: list[list[tuple]] = [[] for _ in range(n_items)]

    def least(self, item: int) -> int:
        """What a document's score must reach."""
        held = self.found[item]
        return -held[-1][0] if len(held) == self.k else 1

    def put(self, item: int, scores: np.ndarray, keys: list) -> None:
        rows = [(-int(s), key is None, 0 if key is None else key) for s, key in zip(scores, keys, strict=True)]
        self.found[item] = sorted(self.found[item] + rows)[: self.k]


def search_shard(query: _Query, best: _Best, keys: list, lengths: np.ndarray, lists: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> None:
    """Puts into ``best`` the documents of one shard that rank; ``lists`` has each term's postings in parts, by its number."""
    postings = {}
    for term, parts in lists.items():
        docs, times = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
        order = np.argsort(docs, kind="stable")  # parts of one list may come in any order
        postings[term] = docs[order], times[order]
    fades = np.array([min(query.fade(int(n)), 1 << 53) for n in lengths.tolist()], np.int64)
    scored, bounds = {}, {}
    for term, (docs, times) in postings.items():
        scored[term] = query.weights[term] * ((1_000_000_000 * times) // (1000 * times + 20 * fades[docs]))
        bounds[term] = int(scored[term].max())
    sums, probe = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
    for item, all_terms in enumerate(query.items):
        terms = sorted((t for t in all_terms.tolist() if bounds.get(t)), key=lambda t: -bounds[t])
        if not terms:
            continue
        left, least, touched, at = sum(bounds[t] for t in terms), best.least(item), [], 0
        while at < len(terms) and left >= least:  # essential lists: every document may still come in by them
            docs = postings[terms[at]][0]
            sums[docs] += scored[terms[at]]
            touched.append(docs)
            left -= bounds[terms[at]]
            at += 1
            if at < len(terms) and len(docs) >= query.k:
                least = max(least, _kth(sums[docs], query.k))
        if not touched:
            continue
        docs = np.concatenate(touched) if len(touched) == 1 else np.unique(np.concatenate(touched))
        least = max(least, _kth(sums[docs], query.k))
        docs = docs[sums[docs] + left >= least]
        for term in terms[at:]:  # non-essential lists: looked up only for documents that can still qualify
            if not len(docs):
                break
            held, worth = postings[term][0], scored[term]
            if len(held) > 8 * len(docs):
                place = np.searchsorted(held, docs)
                place[place == len(held)] = 0
                hit = held[place] == docs
                sums[docs[hit]] += worth[place[hit]]
            else:
                probe[held] = np.arange(len(held))
                place = probe[docs]
                hit = place >= 0
                sums[docs[hit]] += worth[place[hit]]
                probe[held] = -1
            left -= bounds[term]
            least = max(least, _kth(sums[docs], query.k))
            docs = docs[sums[docs] + left >= least]
        won = docs[sums[docs] >= least]
        if len(won):
            best.put(item, sums[won], [keys[d] for d in won.tolist()])
        for held in touched:
            sums[held] = 0


def _kth(scores: np.ndarray, k: int) -> int:
    """A bound from below of the k-th best final score: the k-th best so far, or 1."""
    return max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) >= k else 1


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, dict]]:
    """The shards of a task that have a sought term, one by one; rows come sorted by shard, each shard's documents first."""
    shard, keys, lengths, postings = None, [], np.zeros(0, np.int64), {}
    for batch in batches:
        numbers, terms, all_keys, all_docs, all_times = (batch.column(i) for i in range(5))
        for i, (name, term) in enumerate(zip(numbers.to_pylist(), terms.to_pylist(), strict=True)):
            if name != shard:
                if postings:
                    yield keys, lengths, postings
                shard, postings = name, {}
            if term is None:
                keys, lengths = all_keys[i].as_py(), all_times[i].values.to_numpy()
            else:
                postings.setdefault(term, []).append((all_docs[i].values.to_numpy(), all_times[i].values.to_numpy()))
    if postings:
        yield keys, lengths, postings


def _blocks(terms: DataFrame) -> int:
    """Into how many blocks items are dealt, so that one is about ``BLOCK_BYTES``."""
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("n")).first().n
    return -(-int(size) // BLOCK_BYTES)


def search(index: DataFrame, items: DataFrame, k: int = 50, *, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Each item's ``k`` best documents: ``item_key``, rank, ``key``, score.

    ``index`` is a table of :func:`build_index` that is read once for each block
    of items. A term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``; a
    document scores ``w ((10**9 tf) div (1000 tf + 20 m))`` for each of an item's
    terms, m being ``50 + 50 n N div L``. Only scores above 0 rank; equal scores
    go by ascending key, a null key last, and documents with one key rank each.
    Rows of one item key are one item with the terms of all; items without terms
    have no rows, nor has anything if either table is empty.
    """
    kind = index.schema["keys"].dataType.elementType
    item_kind = items.select(F.col(item_key).alias("i")).schema["i"].dataType
    asked = items.select(F.struct(F.col(item_key).alias("id")).alias("item"), F.explode(terms_of(F.col(text))).alias("t")).select("item", F.col("t").cast("binary").alias("term")).distinct()
    asked = keep(asked, "search-terms")
    n_blocks = _blocks(asked)
    total = index.where("term IS NULL").agg(F.sum(F.size(F.filter("times", lambda n: n > 0))).alias("n"), F.sum(F.aggregate("times", F.lit(0).cast("long"), lambda s, n: s + n)).alias("l")).first()
    schema = T.StructType([T.StructField(item_key, item_kind), T.StructField(key, kind), T.StructField("score", T.LongType())])
    if not n_blocks or not total.l:
        return index.sparkSession.createDataFrame([], schema).select(item_key, F.lit(1).alias("rank"), key, "score")
    found = None
    for block in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block) if n_blocks > 1 else asked
        rows = _search_block(index, mine, int(total.n), int(total.l), k, schema)
        found = rows if found is None else found.unionByName(rows)
    # Two steps, so that no task gets one item's rows of all tasks unless they are few.
    order = [F.desc("score"), F.asc_nulls_last(key)]
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    first = Window.partitionBy(item_key, "spread").orderBy(*order)
    found = found.withColumn("spread", spread).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    last = Window.partitionBy(item_key).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return found.select(item_key, "rank", key, "score")


def _search_block(index: DataFrame, asked: DataFrame, n_docs: int, n_terms: int, k: int, schema: T.StructType) -> DataFrame:
    """Each task's best documents for the items of a block of bounded size."""
    spark = index.sparkSession
    rows = asked.groupBy("term").agg(F.collect_list("item").alias("items")).orderBy("term").collect()  # about BLOCK_BYTES
    numbers = {bytes(r.term): n for n, r in enumerate(rows)}
    of_item: dict[object, list[int]] = {}
    for n, r in enumerate(rows):
        for i in r["items"]:
            of_item.setdefault(i.id, []).append(n)
    items = [np.array(t, np.int64) for t in of_item.values()]
    words = F.broadcast(spark.createDataFrame(list(numbers.items()), "term binary, number int"))
    postings = index.join(words, "term")
    counts = {r.number: r.df for r in postings.groupBy("number").agg(F.sum("df").alias("df")).collect()}  # a row a term
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(n, 0) + 1))) for n in range(len(numbers))], np.int64)
    query = spark.sparkContext.broadcast(_Query(list(of_item), items, weights, n_docs, n_terms, k))

    columns = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = query.value
        best = _Best(len(q.items), q.k)
        for keys, lengths, lists in _streamed(batches):
            search_shard(q, best, keys, lengths, lists)
        out = [(q.names[i], None if none else key, -score) for i, held in enumerate(best.found) for score, none, key in held]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), columns, strict=True)], schema=columns)

    columns_read = ["keys", "docs", "times"]
    documents = index.where("term IS NULL").select("shard", F.lit(None).cast("int").alias("term"), *columns_read)
    both = postings.select("shard", F.col("number").alias("term"), *columns_read).unionByName(documents)
    return both.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("term")).mapInArrow(run, schema)
