"""Near vectors against all pairs."""

from __future__ import annotations

import numpy as np
from tessera.llm import op2_near_vectors as nv

SCHEMA = "vec_id long, embedding array<float>, n_links string, rep long"


def brute(rows, threshold=0.9):
    ids = [k for k, *_ in rows]
    usable = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    vectors = [np.array(v, np.float32).astype(np.float64) if k is not None and usable(v) else None for k, v, *_ in rows]
    links = np.zeros(len(rows), int)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k if k is not None else -1, int(links[i]), least.get(find(i), -1) if k is not None else -1) for i, k in enumerate(ids))


def test_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + 0.25 * rng.standard_normal(16)).tolist(), "x", 1) for i in range(150)]
    rows += [(200 + i, rows[0][1], "x", 1) for i in range(20)]
    rows += [(300, None, "x", 1), (301, [0.0] * 16, "x", 1), (302, [float("nan")] * 16, "x", 1), (303, [1.0, None] + [0.0] * 14, "x", 1), (304, [float("inf")] + [0.0] * 15, "x", 1), (305, [], "x", 1), (306, [1.0, 2.0], "x", 1), (307, [2.0, 4.0], "x", 1), (None, rows[0][1], "x", 1)]
    got = nv.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    mine = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in got)
    assert mine == brute(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_large_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(nv, "BLOCK", 16)
    rng = np.random.default_rng(5)
    one = rng.standard_normal(8)
    rows = [(i, (one + 0.2 * rng.standard_normal(8)).tolist(), "x", 1) for i in range(120)]
    got = nv.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)


def test_empty_table(spark):
    assert nv.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
