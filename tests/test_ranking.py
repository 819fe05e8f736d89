"""Ranks against a plain loop over all passages, with few and many shards and blocks."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from tessera.functions.stemming import STEMMERS
from tessera.functions.words import SUPPORTED, stop_words
from tessera.operators import lexical, ranking

SCHEMA = "id long, lang string, t string, score double, rank int, k string"


def words_of(text, lang=None):
    found = ranking._RANKING.findall((text or "").lower())
    if lang is None:
        return found
    return [STEMMERS.get(lang, str)(w) for w in found if w not in stop_words(lang)]


def plain(rows, asked, k, by_language=False, overlap=False):
    groups = {}
    for r in rows:
        code = (r[1] if r[1] in SUPPORTED else "other") if by_language else "other"
        groups.setdefault(code, []).append((r[0], r[2]))
    found = []
    for code, own in groups.items():
        cut = (lambda t: set(w for w in ranking._WORD.findall((t or "").lower()) if len(w) > 2)) if overlap else (lambda t, c=code: words_of(t, c if by_language else None))
        counts = [(key, Counter(cut(t))) for key, t in own]
        mean = sum(c.total() for _, c in counts) / len(counts) or 1
        df = Counter(w for _, c in counts for w in c)
        for q, text in asked:
            scored = []
            for key, c in counts:
                s = sum(1 if overlap else math.log1p((len(counts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for w in set(cut(text)) if c[w])
                s = math.floor(s * 1000 + 0.5) / 1000
                if s > 0:
                    scored.append((-s, key is None, key or 0))
            found += [(q, None if none else key, code, -s, n + 1) for n, (s, none, key) in enumerate(sorted(scored)[:k])]
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    names = [f"{a}{b}{end}" for a in ("tele", "mono", "poly", "para", "meta") for b in ("graph", "phon", "gram", "cycl", "morph") for end in ("", "s", "ing", "en", "er")]
    text = lambda n: " ".join(rng.choices(names, [1 / (i + 1) for i in range(len(names))], k=n))
    rows = [(i, rng.choice(["en", "de", "xx", None]), text(rng.randint(0, 30))) for i in range(300)]
    rows += [(900, "en", None), (901, "de", ""), (None, "en", text(9)), (902, "en", "the of and"), (903, "fr", "graph " * 5000)] + [(950, "de", text(5))] * 2 + [(i, "en", "telegraph monograms") for i in range(1000, 1030)]
    return rows, [(q, text(rng.randint(1, 8))) for q in range(15)] + [(20, "the"), (21, "nothing known"), (22, "")]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("kind", ["plain", "language", "overlap"])
def test_as_brute_force(spark, monkeypatch, corpus, small, kind):
    if small:
        monkeypatch.setattr(ranking, "SHARD", 20)
        monkeypatch.setattr(ranking, "BLOCK_BYTES", 900)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rows, asked = corpus
    passages = spark.createDataFrame([(*r, 0.5, 1, "x") for r in rows], SCHEMA).repartition(3)
    queries = spark.createDataFrame(asked, "query long, query_text string")
    if kind == "overlap":
        out = lexical.overlap(passages, queries, "id", "t", top_k=5)
    else:
        out = lexical.bm25(passages, queries, "id", "t", top_k=5, lang="lang" if kind == "language" else None)
    try:
        got = sorted(((r.query, r.id, r.lang if kind == "language" else "other", r.score, r["rank"]) for r in out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert got == plain(rows, asked, 5, kind == "language", kind == "overlap")


def test_empty_tables_and_repeats(spark):
    none = spark.createDataFrame([], "id long, lang string, t string")
    asked = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, None)], "query long, query_text string")
    assert lexical.bm25(none, asked, "id", "t").collect() == []
    some = spark.createDataFrame([(1, "en", "alpha"), (2, "en", "beta"), (3, "en", "gamma")], "id long, lang string, t string")
    assert lexical.bm25(some, asked.limit(0), "id", "t").collect() == []
    assert sorted((r.query, r.id) for r in lexical.bm25(some, asked, "id", "t").collect()) == [(1, 1), (1, 2)]


def test_non_essential_lists_are_only_looked_up():
    import numpy as np

    unit = ranking.UNIT
    lists = [(9 * unit, np.arange(3), np.full(3, 9 * unit)), (unit, np.arange(1000), np.full(1000, unit))]
    docs, scores = ranking._taken(lists, 1, 3, 1000, ranking._three_places)
    assert docs.tolist() == [0, 1, 2] and scores.tolist() == [10_000] * 3
    docs, _ = ranking._taken(lists, 10_001, 3, 1000, ranking._three_places)
    assert len(docs) == 0


def test_stemmed_keywords(spark):
    rows = [(1, "en", "Connected connections"), (2, "de", "Toleranzen"), (3, "ru", "вагоны и вагонов"), (4, "xx", "connect"), (5, "en", "unconnected"), (5, "en", "connect")]
    passages = spark.createDataFrame(rows, "id long, lang string, t string")
    terms = spark.createDataFrame([("en", "connecting"), ("de", "Toleranz"), ("ru", "вагон"), ("xx", "connect")], "lang string, term string")
    got = {r.id: (r.terms, r.hits) for r in lexical.keyword_hits(passages, terms, "id", "t").collect()}
    assert got == {1: (["connecting"], 2), 2: (["Toleranz"], 1), 3: (["вагон"], 2), 4: (["connect"], 1), 5: (["connecting"], 1)}


def test_overlap_by_lower_case_alone(spark):
    rows = [(1, "weißt"), (2, "weisst"), (3, "sß auf"), (4, "WEIẞT auf")]
    passages = spark.createDataFrame(rows, "id long, t string")
    asked = spark.createDataFrame([(7, "Weißt sß")], "k long, q string")
    told = lambda **how: sorted((r.id, r.score) for r in lexical.overlap(passages, asked, "id", "t", query="k", query_text="q", **how).collect())
    assert told() == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)]
    assert told(sharp_s="ß") == [(1, 1.0), (4, 1.0)]


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_stemmed_words_are_not_shuffled(spark, monkeypatch, few):
    """Only words that have a wanted stem go to the texts, and only texts in a language of the terms are read; null is one for phrases."""
    monkeypatch.setattr(lexical, "FEW_WORDS", few)
    rows = [(1, "en", "Things and thing of the things"), (2, "fr", "things of the"), (3, None, "of the things"), (4, "de", "things"), (5, "en", None), (6, "en", "of-the thinging")]
    passages = spark.createDataFrame(rows, "id long, lang string, t string")
    terms = spark.createDataFrame([("en", "things"), ("en", "of the"), (None, "of the"), ("es", "nada")], "lang string, term string")
    found = lexical.keyword_hits(passages, terms, "id", "t")
    got = {r.id: (r.terms, r.hits) for r in found.collect()}
    assert got == {1: (["of the", "things"], 5), 3: (["of the"], 1), 6: (["things"], 1)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 1 and plan.count("strategy=broadcast") == plan.count("LeftSemi") + (1 if few else 0)
