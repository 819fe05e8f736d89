"""The n-gram join against all pairs."""

from __future__ import annotations

import random
import re

from tessera.llm import op3_ngram_join as nj

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = TOKEN.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k if k is not None else -1), len(sets[i]), least.get(find(i), -1) if k is not None else -1, links[i]) for i, (k, _) in enumerate(rows))


def shown(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id if r.component_id is not None else -1, r.n_links) for r in df.collect())


def test_against_all_pairs(odd_docs, odd_rows):
    mine, theirs = shown(nj.ngram_join(odd_docs)), brute(odd_rows)
    assert [x[:3] for x in mine if x[0] >= 0] == [x[:3] for x in theirs if x[0] >= 0]
    single = {k for k, _ in odd_rows if k is not None and sum(j == k for j, _ in odd_rows) == 1}
    assert [x for x in mine if x[0] in single] == [x for x in theirs if x[0] in single]


def test_chain_of_near_copies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(40):
        own = list(base)
        own[d] = f"new{d}"
        own[(7 * d + 3) % 60] = f"other{d}"
        rows.append((d, " ".join(own)))
    rows += [(100, " ".join(base)), (101, " ".join(base[:50])), (102, " ".join(base[:30]))]
    assert shown(nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_frequent_grams_only(spark):
    line = "this line stands in very many texts of the table"
    rows = [(d, f"{line} " * 3 + f"x{d}") for d in range(60)] + [(d, line) for d in range(100, 140)]
    assert shown(nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty_table(no_docs):
    assert nj.ngram_join(no_docs).collect() == []


def test_two_bundles_in_one_family(spark, monkeypatch):
    """Members near to the family's common set, members far from it, and pairs that only their differences decide."""
    monkeypatch.setattr(nj, "BLOCK", 8)
    rng = random.Random(13)
    base = [f"w{i}" for i in range(150)]
    other = base[:118] + [f"v{i}" for i in range(32)]
    rows = []
    for d in range(90):
        own = list(base if d % 3 else other)
        for _ in range(rng.randint(0, 5)):
            own[rng.randint(0, 149)] = f"e{rng.randint(0, 40)}"
        rows.append((d, " ".join(own)))
    assert shown(nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_sets_without_a_key_connect_and_count(spark):
    words = [f"w{i}" for i in range(100)]
    steps = [" ".join(words[k : k + 60]) for k in (0, 6, 12)]  # each links with the next alone
    rows = [(1, steps[0]), (None, steps[1]), (3, steps[2])]
    got = {r.doc_id: (r.component_id, r.n_links) for r in nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), None: (None, 2), 3: (1, 1)}


def test_a_family_of_thousands_is_answered_by_its_differences(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(5000):
        own = list(base)
        own[d % 200] = f"e{d}"
        rows.append((d, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = nj.ngram_join(frame).selectExpr("count(*)", "min(n_links)", "max(n_links)", "max(component_id)").first()
    assert tuple(got) == (5000, 4999, 4999, 0)


def test_blocks_that_cannot_link_are_skipped():
    import numpy as np

    rng = np.random.default_rng(3)
    e = np.zeros(400, nj._ENTRY)
    e["gram"], e["node"], e["size"], e["at"] = rng.integers(0, 6, 400), np.arange(400), rng.integers(40, 90, 400), rng.integers(0, 20, 400)
    e = e[np.lexsort((e["at"], e["size"], e["gram"]))]
    got = {(int(i), int(j)) for a, b, _ in nj.block_pairs(e, 75) for i, j in zip(a, b, strict=True)}
    wanted = set()
    for i in range(400):
        for j in range(i + 1, 400):
            x, y = e[i], e[j]
            least, need = nj.demanded(np.int64(x["size"]), np.int64(y["size"]), 75)
            fits = x["gram"] == y["gram"] and int(x["size"]) * 100 >= int(y["size"]) * 75
            if fits and x["at"] < int(x["size"]) - least + need and y["at"] < int(y["size"]) - least + need:
                wanted.add((i, j))
    assert got == wanted


def test_the_most_frequent_are_never_none(spark):
    from tessera.llm.words import most_frequent

    same = spark.range(1000).selectExpr("id", "cast(1 << 30 as long) as n")
    assert 50 < most_frequent(same, "id", "n", 100).count() < 150
    steps = spark.range(1, 1001).selectExpr("id", "id * id as n")
    top = {r.id for r in most_frequent(steps, "id", "n", 100).collect()}
    assert {i for i in range(910, 1001)} <= top and len(top) < 120
