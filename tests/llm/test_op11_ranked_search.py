"""Ranks against a plain loop over all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tessera.llm import op11_ranked_search as rs
from tessera.llm.workspace import keep

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string, term string, score long, rank int, shard long"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    counts = [(key, Counter(terms(text))) for key, text in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    found = []
    for i, wanted in asked.items():
        scored = []
        for key, c in counts:
            m = 100 - 50 + 50 * c.total() * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if s > 0:
                scored.append((-s, key is None, key or 0))
        found += [(i, n + 1, None if none else key, -s) for n, (s, none, key) in enumerate(sorted(scored)[:k])]
    return found


def ranked(spark, docs, items, k, parts=3):
    frame = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in docs], "doc_id long, text string, term string, score long, shard long").repartition(parts)
    asked = spark.createDataFrame([(a, b, "x", 1, 2, 3) for a, b in items], ITEM)
    out = rs.search(keep(rs.build_index(frame), "index"), asked, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return [tuple(r) for r in out.collect()]


@pytest.fixture()
def corpus():
    rng = random.Random(8)
    names = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda n: " ".join(rng.choices(names, weights, k=n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(400)] + [(1000 + i, "w0 w1 w2 W3") for i in range(40)]
    return docs, [(i, text(rng.randint(1, 12))) for i in range(12)]


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_small_shards_and_blocks_as_brute_force(spark, monkeypatch, corpus, k):
    monkeypatch.setattr(rs, "SHARD_DOCS", 37)
    monkeypatch.setattr(rs, "LIST", 10)
    monkeypatch.setattr(rs, "ROWS", 13)
    monkeypatch.setattr(rs, "BLOCK_BYTES", 700 if k == 7 else 1 << 20)
    docs, items = corpus
    want = sorted(brute(docs, items, k))
    assert sorted(ranked(spark, docs, items, k)) == want
    assert k != 7 or rs._blocks(spark.createDataFrame([(t.encode(),) for i, x in items for t in set(terms(x))], "term binary")) > 1


def test_odd_rows(spark, odd_rows):
    """Null and repeated keys and texts, long texts, other alphabets, ties."""
    items = [(1, odd_rows[0][1]), (2, "two ONE one-two"), (3, None), (4, "..., !"), (None, "漢字 É é"), (5, odd_rows[3][1][:60]), (5, odd_rows[4][1][:60]), (6, "nowhere_to be found"), (1, odd_rows[0][1])]
    got = ranked(spark, odd_rows, items, 10)
    assert sorted(map(repr, got)) == sorted(map(repr, brute(odd_rows, items, 10)))


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert ranked(spark, [], items, 5) == []
    assert ranked(spark, docs, [], 5) == []
    assert ranked(spark, [(1, None), (2, " ")], items, 5) == []


def test_non_essential_lists_are_only_probed(corpus):
    """Documents that hold nothing but a frequent term are not summed up once k are better."""
    import numpy as np

    keys = list(range(2000))
    lists = {0: [(np.arange(2000), np.ones(2000, np.int64))], 1: [(np.arange(5), np.full(5, 3, np.int64))]}
    query = rs._Query([1], [np.array([0, 1])], np.array([10, 7000]), 2000, 2015, 3)
    best = rs._Best(1, 3)
    rs.search_shard(query, best, keys, np.full(2000, 1), lists)
    m = query.fade(1)
    assert [(-s, k) for s, _, k in best.found[0]] == [(7000 * (3 * 10**9 // (3000 + 20 * m)) + 10 * (10**9 // (1000 + 20 * m)), k) for k in range(3)]


def test_index_holds_every_term(spark, odd_docs, odd_rows):
    index = rs.build_index(odd_docs)
    got = {bytes(r.term).decode(): r.n for r in index.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.aggregate("times", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).collect()}
    assert got == dict(Counter(t for _, text in odd_rows for t in terms(text)))
