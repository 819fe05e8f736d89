"""Shards against plain minimax over the groups in the same order."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from tessera.llm import op8_sharding as sh


def least_capacity(sizes, n):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        shards, load = 1, 0
        for s in sizes:
            if load + s > mid:
                shards, load = shards + 1, 0
            load += s
        low, high = (low, mid) if shards <= n else (mid + 1, high)
    return low


def test_walk_and_capacity():
    rng = random.Random(3)
    for _ in range(40):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 60))]
        n = rng.randint(1, 12)
        low = sh.smallest_capacity(sizes, n, max(sizes), sum(sizes))
        assert low == least_capacity(sizes, n)
        starts = sh.walk(sizes, low)
        assert len(starts) <= n
        assert all(sum(sizes[a:b]) <= low for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True))


def check(rows, got, n):
    assert Counter(str(r.doc_id) for r in got) == Counter(str(k) for k, _ in rows)
    slots, of_text, loads = defaultdict(list), defaultdict(set), Counter()
    by_key = defaultdict(list)
    for k, t in rows:
        by_key[str(k)].append(t)
    for r in got:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
        assert (r.size, r.text_crc32) in {(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in by_key[str(r.doc_id)]}
        if len(by_key[str(r.doc_id)]) == 1 and by_key[str(r.doc_id)][0] is not None:
            of_text[by_key[str(r.doc_id)][0]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    return loads


def test_odd_rows(odd_docs, odd_rows):
    check(odd_rows, sh.shard(odd_docs, 7).collect(), 7)


def test_capacity_is_the_smallest(spark, monkeypatch):
    monkeypatch.setattr(sh, "FIRST_BITS", 3)
    monkeypatch.setattr(sh, "NODES_A_ROUND", 64)
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400) + str(rng.randint(0, 150))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    loads = check(rows, sh.shard(frame, 9).collect(), 9)
    from pyspark.sql import functions as F

    groups = frame.groupBy(F.xxhash64("text").alias("place")).agg(F.sum(F.octet_length("text") + 16).alias("bytes")).collect()
    key = lambda g: g.place & ((1 << 64) - 1)
    best = min(least_capacity([g.bytes for g in sorted(groups, key=k)], 9) for k in (key, lambda g: g.place))
    assert max(loads.values()) <= max(best, least_capacity([g.bytes for g in sorted(groups, key=lambda g: g.place)], 9))


def test_fewer_groups_than_shards_and_none(spark, no_docs):
    rows = [(1, "a"), (2, "a"), (3, "b")]
    check(rows, sh.shard(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect(), 40)
    assert sh.shard(no_docs, 40).collect() == []


def test_one_row_repeated(spark, monkeypatch):
    """Key and text of most rows are the same, some keys are null: cells stay small."""
    monkeypatch.setattr(sh, "CELL_ROWS", 50)
    rows = [(1, "same")] * 2000 + [(None, "same")] * 1000 + [(2, "x" * 300_000), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = []
    real = sh.Window.partitionBy
    monkeypatch.setattr(sh.Window, "partitionBy", lambda *c: (seen.append(c), real(*c))[1])
    got = sh.shard(df, 4)
    check(rows, got.collect(), 4)
    assert ("shard", "block", "part") in seen
    assert got.where("text_crc32 = crc32('same')").select("shard").distinct().count() == 1
