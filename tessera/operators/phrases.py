"""Which texts hold which of many phrases: one pass over each text with an automaton of all of them.

Phrases go to the tasks in blocks of bounded size; each block is one scan of the
texts, and no text is moved or joined. A task builds the automaton of a block
once and keeps it while it works on that block. The few shortest phrases, which
a text may have at every other place, are sought one by one instead, so that
their places are not walked in Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions import text as T
from tessera.functions.batches import pieces

BLOCK_CHARS = 1 << 20
FIRST_WORDS = 8

SHORT_CHARS, SHORT_PHRASES = 4, 64
PATTERNS_KEPT = 4096


@dataclass
class _Phrases:
    """Different phrases with the numbers of the rows that have them: the shortest by themselves, the others as an automaton."""

    short: list[tuple[str, list[int]]]
    automaton: object | None
    patterns: dict[int, object] = field(default_factory=dict)  # of rows, as hits ask for them

    def iter(self, text: str) -> Iterator[tuple[int, tuple[int, list[int]]]]:
        return self.automaton.iter(text) if self.automaton else iter(())


_built: dict[str, _Phrases] = {}


def _phrases_of(block: str, phrases: list[str]) -> _Phrases:
    """The phrases of a broadcast block; a worker holds one block at a time."""
    if block not in _built:
        import ahocorasick

        places: dict[str, list[int]] = {}
        for n, phrase in enumerate(phrases):
            places.setdefault(phrase, []).append(n)
        short = sorted((p for p in places if len(p) <= SHORT_CHARS), key=len)[:SHORT_PHRASES]
        found = _Phrases([(p, places.pop(p)) for p in short], ahocorasick.Automaton() if places else None)
        for phrase, at in places.items():
            found.automaton.add_word(phrase, (len(phrase), at))
        if places:
            found.automaton.make_automaton()
        _built.clear()
        _built[block] = found
    return _built[block]


def _folded(text: str) -> str:
    """Folded so that whatever a search without case takes for the same is the same."""
    return text.lower() if text.isascii() else text.replace("\u0130", "i").replace("\u0131", "i").casefold()


def _scanned(texts: DataFrame, phrases: DataFrame, key: str, phrase_key: str, extra: list[S.StructField], hits: Callable[[_Phrases, pa.RecordBatch, list], Iterator[tuple]], fold: Callable[[str], str] = str) -> DataFrame:
    """Rows of ``key``, ``phrase_key`` and ``extra`` that ``hits`` finds in each batch of ``texts``: the numbers of the text and of the phrase, and ``extra``.

    ``phrases`` has ``phrase_key``, ``_phrase`` and what else ``hits`` reads of it.
    """
    spark = texts.sparkSession
    phrases = phrases.where(F.char_length("_phrase") > 0)
    size = phrases.agg(F.coalesce(F.sum(F.char_length("_phrase") + 16), F.lit(0)).alias("n")).first().n
    blocks = -(-int(size) // BLOCK_CHARS)
    schema = S.StructType([S.StructField(key, texts.schema[key].dataType), S.StructField(phrase_key, phrases.schema[phrase_key].dataType), *extra])
    out = to_arrow_schema(schema)
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        mine = phrases.where(F.pmod(F.xxhash64("_phrase", phrase_key), F.lit(blocks)) == block) if blocks > 1 else phrases
        rows = mine.collect()  # about BLOCK_CHARS code points
        told = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], told=told, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            rows = told.value
            sought = _phrases_of(name, [fold(r._phrase) for r in rows])
            keys = pa.array([r[0] for r in rows], out.field(1).type)
            for batch in pieces(batches, 1):
                got = list(hits(sought, batch, rows))
                if got:
                    of, n, *more = zip(*got, strict=True)
                    columns = [batch.column(0).take(pa.array(of)).cast(out.field(0).type), keys.take(pa.array(n))]
                    columns += [pa.array(c, f.type) for c, f in zip(more, list(out)[2:], strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=out)

        if rows:
            found = found.unionByName(texts.mapInArrow(run, schema))
    return found


def occurrences(texts: DataFrame, phrases: DataFrame, key: str, text: str, *, phrase_key: str = "term", phrase: str = "term", by: str | None = None) -> DataFrame:
    """``key``, ``phrase_key``, n: how often each text holds each phrase, those that overlap counted once.

    Texts and phrases are compared as they are; fold them before. With ``by``
    only phrases count that have the text's value of this column, which both
    tables have. Null and empty phrases and null texts give no rows; rows that
    repeat give theirs each; in long texts nothing is skipped.
    """
    of = [by] if by else []
    texts = texts.select(key, F.col(text).alias("_text"), *of)
    phrases = phrases.select(phrase_key, F.col(phrase).alias("_phrase"), *[F.col(c).alias("_by") for c in of])

    def hits(sought: _Phrases, batch: pa.RecordBatch, rows: list) -> Iterator[tuple]:
        values = batch.column(2).to_pylist() if by else [None] * len(batch)
        for i, (body, value) in enumerate(zip(batch.column(1).to_pylist(), values, strict=True)):
            if not body:
                continue
            counts: dict[int, int] = {}
            free: dict[int, int] = {}
            for phrase, at in sought.short:
                times = body.count(phrase)
                if times:
                    counts.update((n, times) for n in at)
            for end, (length, at) in sought.iter(body):
                first = at[0]
                if end - length + 1 >= free.get(first, 0):
                    free[first] = end + 1
                    for n in at:
                        counts[n] = counts.get(n, 0) + 1
            for n, times in counts.items():
                if not by or rows[n]._by == value:
                    yield i, n, times

    return _scanned(texts, phrases, key, phrase_key, [S.StructField("n", S.LongType())], hits)


def quoted(texts: DataFrame, quotes: DataFrame, key: str, text: str, *, quote_key: str, quote: str = "quote", fold: Callable[[Column], Column] = T.folded) -> DataFrame:
    """``quote_key`` and ``key`` of each quote and the texts that have it, case and spaces aside.

    The rule is that of :func:`text.quoted_from`: a quote of more than eight
    words passes on its first eight. ``fold`` says what case is; with ``F.lower``
    ß is not ss. Quotes of any length are found, also inside
    words; blank ones are in no text.
    """
    words = F.split(fold(T.collapse(quote)), " ")
    begins = quotes.select(quote_key, F.array_join(F.slice(words, 1, FIRST_WORDS), " ").alias("_begin"))
    folded = texts.select(key, fold(T.collapse(text)).alias("_folded"))
    return occurrences(folded, begins, key, "_folded", phrase_key=quote_key, phrase="_begin").select(quote_key, key)


def quote_places(texts: DataFrame, quotes: DataFrame, key: str, text: str, *, quote_key: str, quote: str = "quote") -> DataFrame:
    """``quote_key``, ``key``, char_from, char_to: a quote's first place in each text that has it.

    Case aside; between a quote's words a text may have any white space and ``>``,
    which is no word of a quote. The automaton tells which quotes a text has with
    both read as one space; only for these the place is looked up, in the text at
    hand.
    """
    bare = T.collapse(F.translate(quote, ">", " "))
    signs = F.when(F.col(quote).rlike(r">[^\s]"), F.lit(">")).otherwise(F.lit(""))
    asked = quotes.select(quote_key, F.when(bare == "", signs).otherwise(bare).alias("_phrase"), F.col(quote).alias("_quote"))
    texts = texts.select(key, F.col(text).alias("_text"))

    def hits(sought: _Phrases, batch: pa.RecordBatch, rows: list) -> Iterator[tuple]:
        import re

        def pattern(n: int) -> re.Pattern | None:
            words = [re.escape(w) for w in rows[n]._quote.split() if w != ">"]
            if len(sought.patterns) >= PATTERNS_KEPT:
                sought.patterns.clear()
            found = sought.patterns[n] = re.compile(r"[\s>]+".join(words), re.IGNORECASE) if words else None
            return found

        for i, body in enumerate(batch.column(1).to_pylist()):
            if not body:
                continue
            spaced = " ".join((body.replace(">", " ") if ">" in body else body).split())
            folded = _folded(spaced)
            ways = [folded] + ([">"] if ">" in body else [])
            first: dict[int, int] = {}  # a row's phrase by its first place in the folded text
            for way in ways:
                for phrase, at in sought.short:
                    begin = way.find(phrase)
                    if begin >= 0:
                        first.update((n, begin) for n in at)
                for end, (length, at) in sought.iter(way):
                    if at[0] not in first:
                        first.update((n, end - length + 1) for n in at)
            same = len(folded) == len(spaced)  # then no place is further on than in the text
            for n, begin in first.items():
                m = sought.patterns[n] if n in sought.patterns else pattern(n)
                m = m and m.search(body, begin if same and ">" not in rows[n]._quote else 0)
                if m:
                    yield i, n, m.start(), m.end()

    fields = [S.StructField("char_from", S.IntegerType()), S.StructField("char_to", S.IntegerType())]
    return _scanned(texts, asked, key, quote_key, fields, hits, _folded).select(quote_key, key, "char_from", "char_to")
