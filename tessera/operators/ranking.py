"""The best passages for each query, without pairing every query with every passage.

Passages are cut into words once; what is kept of one is its length and the
numbers and counts of its sought words. A task then reads its passages in shards,
each an inverted list for every sought word with the list's greatest worth.
A query takes its lists from the greatest worth down, while a passage outside
those taken could still rank; the other lists are only looked up for passages
that can. Of a task only the best of each query leave it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions import stemming
from tessera.functions import words as W
from tessera.functions.batches import pieces
from tessera.session import checkpointed

BLOCK_BYTES = 8 << 20
SHARD = 8192
SPREAD = 64
UNIT = 10**12
K1, B = 1.5, 0.75
OTHER = "other"

_RANKING, _WORD = re.compile(r"\w\w+"), re.compile(r"\w+")


@dataclass(frozen=True)
class Words:
    """How texts become words: for ranking, or every distinct word of more than two letters; by language or as they are."""

    distinct: bool = False
    by_language: bool = False
    stop_words: frozenset[str] = frozenset()
    sharp_s: str = "ss"  # what ß is read as where words are distinct

    def of(self, text: str, lang: str, stems: stemming.Stems) -> list[str]:
        if self.distinct:
            return list(dict.fromkeys(w for w in _WORD.findall(text.lower().replace("ß", self.sharp_s)) if len(w) > 2))
        found = [w for w in _RANKING.findall(text.lower()) if w not in self.stop_words]
        if not self.by_language:
            return found
        stops = set(W.stop_words(lang))
        return [stems.of(lang, w) for w in found if w not in stops]


@dataclass
class _Block:
    """The queries of a block: for each query and language the numbers of its words."""

    names: list
    langs: list[str]
    numbers: dict[tuple[str, str], int]
    asked: list[tuple[int, str, np.ndarray]]


def _block(rows: list, query: str, langs: list[str], words: Words) -> _Block:
    stems, numbers = stemming.Stems(), {}
    names = list(dict.fromkeys(r[query] for r in rows))
    asked = []
    for i, name in enumerate(names):
        text = " ".join(r._text or "" for r in rows if r[query] == name) if len(rows) != len(names) else rows[i]._text or ""
        for lang in langs:
            own = {numbers.setdefault((lang, w), len(numbers)) for w in words.of(text, lang, stems)}
            if own:
                asked.append((i, lang, np.array(sorted(own), np.int64)))
    return _Block(names, langs, numbers, asked)


def _listed(passages: DataFrame, block: _Block, words: Words) -> DataFrame:
    """k, lang, n_words, at, times: the sought words of each passage by number, with how often it has them."""
    told = passages.sparkSession.sparkContext.broadcast((block.numbers, words))
    schema = S.StructType([passages.schema["k"], S.StructField("lang", S.StringType()), S.StructField("n_words", S.LongType()), S.StructField("at", S.ArrayType(S.IntegerType())), S.StructField("times", S.ArrayType(S.LongType()))])
    columns = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, words = told.value
        stems = stemming.Stems()
        for batch in pieces(batches, 2):
            rows = []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = words.of(text or "", lang, stems)
                counts = Counter(numbers.get((lang, w), -1) for w in found)
                counts.pop(-1, None)
                rows.append((len(found), list(counts), list(counts.values())))
            if rows:
                rest = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(columns)[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *rest], schema=columns)

    return passages.mapInArrow(run, schema)


class _Best:
    """The best of each query so far: score, then key; null keys last."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.found = k, [[] for _ in range(n)]

    def least(self, i: int) -> int:
        return -self.found[i][-1][0] if len(self.found[i]) == self.k else 1

    def put(self, i: int, scores: np.ndarray, keys: list) -> None:
        self.found[i] = sorted(self.found[i] + [(-int(s), key is None, 0 if key is None else key) for s, key in zip(scores, keys, strict=True)])[: self.k]


def _taken(lists: list[tuple[int, np.ndarray, np.ndarray]], least: int, k: int, n: int, rounded: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Passages of a shard that may rank, and their scores; ``lists`` fall by their bound."""
    sums, left = np.zeros(n, np.int64), sum(b for b, _, _ in lists)
    seen = np.zeros(n, bool)
    at = 0
    while at < len(lists) and rounded(left) >= least:
        bound, docs, worth = lists[at]
        sums[docs] += worth
        seen[docs] = True
        left -= bound
        at += 1
        if len(docs) >= k:
            least = max(least, int(rounded(np.partition(sums[docs], len(docs) - k)[len(docs) - k])))
    docs = np.flatnonzero(seen)
    place = np.full(n, -1, np.int64)
    for bound, held, worth in lists[at:]:
        docs = docs[rounded(sums[docs] + left) >= least]
        if not len(docs):
            break
        place[held] = np.arange(len(held))
        hit = docs[place[docs] >= 0]
        sums[hit] += worth[place[hit]]
        place[held] = -1
        left -= bound
        if len(docs) >= k:
            least = max(least, int(rounded(np.partition(sums[docs], len(docs) - k)[len(docs) - k])))
    scores = rounded(sums[docs])
    return docs[scores >= least], scores[scores >= least]


def _three_places(units: np.ndarray | int) -> np.ndarray | int:
    """Scores in thousandths, as ranks compare them."""
    return (units + UNIT // 2000) // (UNIT // 1000)


def top_ranked(passages: DataFrame, queries: DataFrame, key: str, text: str, *, query: str, query_text: str, top_k: int, words: Words, lang: str | None = None, overlap: bool = False) -> DataFrame:
    """``query``, ``key``, lang, score, rank of the best passages of each query and language.

    Without ``lang`` there is one language, ``other``; with it, passages of
    languages that are not supported are ``other`` too. Scores are BM25, or with
    ``overlap`` how many words are shared, rounded to three places; those of 0
    are left out, equal ones go by key, null last. Rows of one query are asked
    together. Passages that repeat rank each; null texts have no words.
    """
    spark = passages.sparkSession
    known = list(W.SUPPORTED)
    code = F.when(F.col(lang).isin(known), F.col(lang)).otherwise(OTHER) if lang else F.lit(OTHER)
    rows = passages.select(F.col(key).alias("k"), code.alias("lang"), F.col(text).alias("text"))
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect()) if lang else [OTHER]  # at most those supported and one
    asked = queries.select(query, F.col(query_text).alias("_text")).where("_text is not null")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("_text") + 16), F.lit(0)).alias("n")).first().n
    blocks = -(-int(size) * len(langs) // BLOCK_BYTES)
    schema = S.StructType([S.StructField(query, queries.schema[query].dataType), S.StructField(key, passages.schema[key].dataType), S.StructField("lang", S.StringType()), S.StructField("thousandths", S.LongType())])
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b) if blocks > 1 else asked
        found = found.unionByName(_of_block(rows, _block(mine.collect(), query, langs, words), words, schema, top_k, overlap))  # about BLOCK_BYTES
    order = [F.desc("thousandths"), F.asc_nulls_last(key)]
    best = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    # In two steps, so that no task gets a query's rows of all tasks unless they are few.
    found = found.withColumn("spread", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
    found = found.withColumn("rank", best([query, "lang", "spread"])).where(F.col("rank") <= top_k)
    found = found.withColumn("rank", best([query, "lang"])).where(F.col("rank") <= top_k)
    return found.select(query, key, "lang", (F.col("thousandths") / 1000).alias("score"), "rank")


def _of_block(rows: DataFrame, block: _Block, words: Words, schema: S.StructType, top_k: int, overlap: bool) -> DataFrame:
    spark = rows.sparkSession
    listed = checkpointed(_listed(rows, block, words))
    sums = {r.lang: (r.n, r.mean) for r in listed.groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_words").alias("mean")).collect()}  # a row a language
    counts = {r.at: r.df for r in listed.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).collect()}  # a row a sought word
    idf = np.zeros(len(block.numbers))
    for (lang, _), n in block.numbers.items():
        of, df = sums.get(lang, (0, 0))[0], counts.get(n, 0)
        idf[n] = 1.0 if overlap else np.log1p((of - df + 0.5) / (df + 0.5))
    means = {code: mean or 1.0 for code, (_, mean) in sums.items()}
    told = spark.sparkContext.broadcast((block, idf, means))
    columns = to_arrow_schema(schema)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SHARD:
                yield held
                held = []
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, idf, means = told.value
        best = _Best(len(block.asked), top_k)
        for held in shards(batches):
            table = pa.Table.from_batches(held).combine_chunks()
            keys, at = table.column(0), table.column(3).combine_chunks()
            sizes = np.diff(at.offsets.to_numpy())
            docs = np.repeat(np.arange(table.num_rows), sizes)
            numbers, times = at.flatten().to_numpy().astype(np.int64), table.column(4).combine_chunks().flatten().to_numpy()
            if overlap:
                worth = np.full(len(docs), UNIT, np.int64)
            else:
                mean = np.array([means[code] for code in table.column(1).to_pylist()])
                fade = K1 * (1 - B + B * table.column(2).to_numpy() / mean)
                worth = np.rint(UNIT * idf[numbers] * times / (times + fade[docs])).astype(np.int64)
            order = np.argsort(numbers, kind="stable")
            firsts = np.searchsorted(numbers[order], np.arange(len(idf) + 1))
            lists = {n: (docs[o := order[firsts[n] : firsts[n + 1]]], worth[o]) for n in np.unique(numbers).tolist()}
            bounds = {n: int(w.max()) for n, (_, w) in lists.items()}
            for i, (_, _, own) in enumerate(block.asked):
                mine = sorted(((bounds[n], *lists[n]) for n in own.tolist() if bounds.get(n)), key=lambda x: -x[0])
                if mine:
                    won, scores = _taken(mine, best.least(i), top_k, table.num_rows, _three_places)
                    if len(won):
                        best.put(i, scores, keys.take(pa.array(won)).to_pylist())
        out = [(block.names[block.asked[i][0]], None if none else key, block.asked[i][1], -s) for i, rows in enumerate(best.found) for s, none, key in rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), columns, strict=True)], schema=columns)

    return listed.mapInArrow(run, schema)
