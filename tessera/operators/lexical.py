"""Lexical retrieval over passages: keyword hits, BM25, word overlap, and how they are merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import words as W
from tessera.functions.stemming import stems
from tessera.operators import phrases, ranking
from tessera.session import checkpointed

FEW_TERMS = 64
FEW_WORDS = 1 << 18


def keyword_hits(passages: DataFrame, keywords: DataFrame, key: str, text: str, *, stem: bool = True) -> DataFrame:
    """``key``, terms (sorted) and hits of passages that mention any keyword.

    ``passages`` has a column lang where words are stemmed; ``keywords`` has
    term and, then, lang. A term counts by the stem of its first word, and a term
    of several words also as a phrase, case aside. Of terms with one stem the
    last by name wins. All phrases are sought in one pass over each text. A few terms without stems are first sought as they are, so that only
    texts that have one are cut into words. With stems only texts in a language of
    the terms are read, and the words that have a wanted stem are sent to the
    texts while they are not more than ``FEW_WORDS``, so that words are not shuffled.
    """
    terms = keywords.where(~T.blank("term")).withColumn("term", F.btrim("term"))
    langs = ["lang"] if stem else []
    words, first = W.tokens(F.col(text)), W.tokens(F.col("term"))
    if stem:
        first = stems(first, F.col("lang"))
    by_stem = terms.withColumn("_words", first).where(F.size("_words") > 0).groupBy(F.col("_words")[0].alias("_token"), *langs).agg(F.max("term").alias("term"))
    few = [] if stem else [r.term for r in terms.limit(FEW_TERMS + 1).select(T.folded("term").alias("term")).collect()]
    if 0 < len(few) <= FEW_TERMS:
        first_words = F.array(*[F.lit(t) for t in few])
        heads = F.filter(F.transform(first_words, lambda t: F.get(W.tokens(t), F.lit(0))), lambda t: t.isNotNull())
        passages = passages.where(F.exists(heads, lambda t: F.contains(T.folded(text), t)))
    if stem:
        spoken_in = F.broadcast(terms.select(F.col("lang").alias("_of")).distinct())
        passages = passages.join(spoken_in, F.col("lang").eqNullSafe(F.col("_of")), "left_semi")
    counted = passages.select(key, *langs, F.explode(words).alias("_token"))
    if stem:  # each distinct word is cut to its stem once, and only those that a term wants are joined back
        own = F.array_distinct(words)
        every = passages.select("lang", F.explode(own).alias("_token")).distinct()
        stemmed = every.select("lang", "_token", stems(F.array("_token"), F.col("lang"))[0].alias("_stem"))
        by_stem = checkpointed(stemmed.join(by_stem.withColumnRenamed("_token", "_stem"), ["_stem", "lang"]).drop("_stem"))
        if by_stem.limit(FEW_WORDS + 1).count() <= FEW_WORDS:
            by_stem = F.broadcast(by_stem)
    single = counted.join(by_stem, ["_token", *langs]).groupBy(key, "term").agg(F.count("*").alias("n"))
    spoken = terms.where(F.contains("term", F.lit(" "))).select("term", T.folded("term").alias("_phrase"), *langs).distinct()
    body = passages.select(key, T.folded(text).alias("_body"), *langs)
    spoken = phrases.occurrences(body, spoken, key, "_body", phrase="_phrase", by="lang" if stem else None)
    every = single.unionByName(spoken).groupBy(key, "term").agg(F.sum("n").alias("n"))
    return every.groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("terms"), F.sum("n").alias("hits"))


def bm25(passages: DataFrame, queries: DataFrame, key: str, text: str, *, query: str = "query", query_text: str = "query_text", top_k: int = 6, stop_words: tuple[str, ...] = (), lang: str | None = None) -> DataFrame:
    """``query``, ``key``, score and rank of the best passages for each query.

    Weights are ln(1 + (N - df + 0.5) / (df + 0.5)) * tf / (tf + k1 (1 - b + b dl / avgdl)).
    Lengths and N cover all passages. Scores are rounded to three places, those
    of 0 left out. With ``lang``, a column of the passages, words are stems and
    stop words are left out by each language's rules, each language is a corpus of
    its own, and the result has its name: see :func:`merged`.
    """
    words = ranking.Words(by_language=lang is not None, stop_words=frozenset(stop_words))
    found = ranking.top_ranked(passages, queries, key, text, query=query, query_text=query_text, top_k=top_k, words=words, lang=lang)
    return found if lang else found.drop("lang")


def overlap(passages: DataFrame, queries: DataFrame, key: str, text: str, *, query: str = "query", query_text: str = "query_text", top_k: int = 6, sharp_s: str = "ss") -> DataFrame:
    """The same by how many distinct words of more than two letters are shared; ß is read as ``sharp_s``."""
    words = ranking.Words(distinct=True, sharp_s=sharp_s)
    return ranking.top_ranked(passages, queries, key, text, query=query, query_text=query_text, top_k=top_k, words=words, overlap=True).drop("lang")


def in_order(passages: DataFrame, key: str, top_k: int = 6) -> DataFrame:
    """The first passages in document order, for when nothing can be ranked."""
    first = passages.select(key).orderBy(key).limit(top_k)
    return first.withColumns({"score": F.lit(0.0), "rank": F.row_number().over(Window.orderBy(key)), "arbitrary": F.lit(True)})  # top_k rows


def ranked(scored: DataFrame, query: str, order: list[Column], top_k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    return scored.withColumn("rank", nth).where(F.col("rank") <= top_k)


def best_of(tiers: list[DataFrame], query: str) -> DataFrame:
    """For each query the first tier that has any row for it."""
    out = tiers[0]
    for tier in tiers[1:]:
        out = out.unionByName(tier.join(out.select(query).distinct(), query, "left_anti").select(*out.columns))
    return out


def merged(by_language: DataFrame, query: str, key: str, top_k: int) -> DataFrame:
    """Ranks of all languages as one: those that mean something first, by score."""
    return ranked(by_language.drop("rank"), query, [F.col("arbitrary"), F.col("score").desc(), F.col(key)], top_k)


def top_values(rows: DataFrame, column: str, most: int = 3) -> DataFrame:
    """The most frequent values, ties by name."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(most)
