"""Which language a text is in, by counts of three neighbouring letters.

The model is counted from labelled texts: for each language how often it has
each of the ``KNOWN`` most frequent trigrams of all. A text's language is the one
under which its trigrams are likeliest, each language being as likely before.
Weights are whole millionths, so sums do not depend on any order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions import text as T
from tessera.functions.batches import pieces
from tessera.functions.words import LEAST_CHARS, READ_CHARS

KNOWN = 20_000
LANGUAGES = 100
FALLBACK = "en"
MICRO = 1_000_000
HELD = 1 << 20
STRETCH = 1 << 20
_SHIFT = 21


def letters(text: Column, first: int | None = None) -> Column:
    """The words of a text in lower case, with a space before, between and after them.

    If ``first`` is given, those of so many code points, runs of white space being one.
    """
    read = text if first is None else F.substring(T.collapse(text), 1, first)
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(read), r"\P{L}+", " ")), F.lit(" "))


def codes(text: str) -> np.ndarray:
    """The trigrams of a text as numbers."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (points[:-2] << 2 * _SHIFT) | (points[1:-1] << _SHIFT) | points[2:] if len(points) > 2 else points[:0]


def _as_text(code: int) -> str:
    return "".join(chr(code >> _SHIFT * k & (1 << _SHIFT) - 1) for k in (2, 1, 0))


def _stretches(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """The trigrams of texts of any length in arrays of about ``STRETCH`` at most."""
    held, size = [], 0
    for text in texts:
        for begin in range(0, len(text) - 2, STRETCH):
            held.append(codes(text[begin : begin + STRETCH + 2]))
            size += len(held[-1])
            if size >= STRETCH:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def trigrams(labelled: DataFrame, text: str, lang: str, first: int | None = None) -> DataFrame:
    """lang, gram, n: how often the texts of each language have each trigram; rows with a null language are left out.

    Of every text all is read, or its ``first`` code points. Tasks count by
    themselves and send what they hold at the end, or when they hold ``HELD``
    trigrams; Spark adds up.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), letters(F.coalesce(F.col(text), F.lit("")), first).alias("letters"))

    def told(held: dict[str, dict[int, int]]) -> pa.RecordBatch:
        flat = [(lang, _as_text(code), n) for lang, counts in held.items() for code, n in counts.items()]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat, strict=True)], ["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}
        for batch in pieces(batches, 1):
            frame = pd.DataFrame({"lang": batch.column(0).to_pylist(), "letters": batch.column(1).to_pylist()})
            for name, own in frame.groupby("lang")["letters"]:
                counts = held.setdefault(name, {})
                for part in _stretches(own):
                    found, n = np.unique(part, return_counts=True)
                    for code, times in zip(found.tolist(), n.tolist(), strict=True):
                        counts[code] = counts.get(code, 0) + times
            if sum(map(len, held.values())) > HELD:
                yield told(held)
                held = {}
        if any(held.values()):
            yield told(held)

    return rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(counts: DataFrame) -> DataFrame:
    """lang, gram, weight (micro log probability): the model of ``counts``, with one added to every count.

    It has at most ``LANGUAGES`` languages, those with the most trigrams, and
    ``KNOWN`` trigrams; ties go by name. The row with an empty gram has the
    weight of those known trigrams that a language has no row for.
    """
    langs = counts.groupBy("lang").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "lang").limit(LANGUAGES).select("lang")
    counts = counts.join(F.broadcast(langs), "lang", "left_semi")
    known = counts.groupBy("gram").agg(F.sum("n").alias("times")).orderBy(F.desc("times"), "gram").limit(KNOWN).select("gram")
    kept = counts.join(F.broadcast(known), "gram", "left_semi")
    size = known.agg(F.count("*").alias("size"))
    sums = kept.groupBy("lang").agg(F.sum("n").alias("of")).crossJoin(F.broadcast(size))  # one row
    kept = kept.unionByName(sums.select("lang", F.lit("").alias("gram"), F.lit(0).cast("long").alias("n")))
    weight = F.round(MICRO * F.ln((F.col("n") + 1) / (F.col("of") + F.col("size"))), 0).cast("long")
    return kept.join(F.broadcast(sums), "lang").select("lang", "gram", weight.alias("weight"))


def detect(texts: DataFrame, model: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, code, share: the likeliest language of each text and its probability to three places.

    A text that is null, has fewer than ``LEAST_CHARS`` code points with runs of
    white space as one, or has no known trigram is too short to tell and counts as
    ``FALLBACK`` with a share of 0. Of equally likely languages the first by name
    is taken. A text's first ``READ_CHARS`` code points are read.
    """
    rows = model.collect()  # LANGUAGES times KNOWN at most
    names = sorted({r.lang for r in rows})
    grams = np.unique(np.array([codes(r.gram)[0] for r in rows if r.gram], np.int64))
    at = {n: i for i, n in enumerate(names)}
    weights = np.zeros((len(grams), len(names)), np.int64)
    for r in sorted(rows, key=lambda r: r.gram):  # those with an empty gram first
        weights[np.searchsorted(grams, codes(r.gram)[0]) if r.gram else slice(None), at[r.lang]] = r.weight
    told = texts.sparkSession.sparkContext.broadcast((names, grams, weights))
    schema = S.StructType([S.StructField(key, texts.schema[key].dataType), S.StructField("code", S.StringType()), S.StructField("share", S.DoubleType())])
    columns = to_arrow_schema(schema)

    def of(text: str | None) -> tuple[str, float]:
        names, grams, weights = told.value
        found = codes(text) if text and len(grams) else np.zeros(0, np.int64)
        place = np.searchsorted(grams, found)
        place[place == len(grams)] = 0
        place = place[grams[place] == found] if len(found) else place
        if not len(place):
            return FALLBACK, 0.0
        which, times = np.unique(place, return_counts=True)
        sums = times @ weights[which]
        best = int(sums.argmax())
        return names[best], round(1 / float(np.exp((sums - sums[best]) / MICRO).sum()), 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            got = [of(t) for t in batch.column(1).to_pylist()]
            if got:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), list(columns)[1:], strict=True)]], schema=columns)

    long = F.char_length(T.collapse(text)) >= LEAST_CHARS
    return texts.select(key, F.when(long, letters(F.col(text), READ_CHARS)).alias("letters")).mapInArrow(run, schema)
