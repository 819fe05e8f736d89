"""Repeated passages against planted ones."""

from __future__ import annotations

import random

import numpy as np
from tessera.llm import op5_passages
from tessera.llm.words import Words, shingles

SCHEMA = "doc_id long, text string, matched string"


def _prose(rng, n):
    return ["".join(rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)]


def _covered(found, least):
    spans = {}
    for r in found:
        assert r.end_word - r.first_word >= least and r.other_end - r.other_first >= least
        assert r.matched * 4 >= 3 * (r.end_word - r.first_word) - 4
        spans.setdefault(r.doc_id, []).append((r.first_word, r.end_word))
        spans.setdefault(r.other_id, []).append((r.other_first, r.other_end))
    return spans


def test_planted_passages(spark):
    rng = random.Random(3)
    passages = [_prose(rng, n) for n in (60, 52, 51, 200, 75)]
    docs, planted = [], {}
    for d in range(40):
        words = _prose(rng, rng.randint(30, 400))
        if d % 2 == 0:
            p = list(passages[d // 2 % 5])
            if d % 4 == 0 and len(p) > 60:
                for k in range(10, len(p), 20):
                    p[k] = "changed"
                del p[35]
            at = rng.randint(0, len(words))
            planted[d] = (at, at + len(p))
            words[at:at] = p
        docs.append((d, " \n".join(words), "x"))
    docs += [(100, None, "x"), (101, "", None), (102, "few words", "x"), (None, docs[1][1], "x"), (0, docs[0][1], "x")]
    found = op5_passages.repeated_passages(spark.createDataFrame(docs, SCHEMA)).collect()
    spans = _covered(found, 50)
    assert set(spans) == {*planted, 1, None}
    for d, (low, high) in planted.items():
        assert any(a <= low + 3 and b >= high - 3 for a, b in spans[d]), (d, low, high, spans[d])
        assert all(a >= low - 8 and b <= high + 8 for a, b in spans[d])


def test_many_copies_stay_linear(spark):
    rng = random.Random(4)
    base = _prose(rng, 120)
    docs = []
    for d in range(300):
        words = list(base)
        words[rng.randint(0, 119)] = f"w{d}"
        docs.append((d, " ".join(words), ""))
    found = op5_passages.repeated_passages(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id for r in found} == set(range(300))
    assert len({(r.doc_id, r.other_id) for r in found if r.doc_id < r.other_id}) < 4 * 300  # pairs; each has a row from either side


def test_empty_table(spark):
    found = op5_passages.repeated_passages(spark.createDataFrame([], SCHEMA))
    assert found.collect() == []


def test_seeds_cover_every_reach():
    import pyarrow as pa

    rng = random.Random(5)
    words = Words(pa.array([" ".join(_prose(rng, 300)).encode(), " ".join(_prose(rng, 80)).encode()], pa.binary()), 0, 2)
    found = op5_passages.seeds(words)
    names, begin = shingles(words, op5_passages.SEED_WORDS)
    for d in range(2):
        at = found["at"][found["node"] == d]
        assert (np.diff(at) <= op5_passages.NEIGHBOURS).all()
        assert (names[begin[d] + at] == found["seed"][found["node"] == d]).all()


def test_chain_prefers_order_and_pays_for_gaps():
    runs = [(0, 20, 100), (22, 40, 122), (10, 16, 10), (400, 410, 510)]
    chains = op5_passages.chain(runs)
    assert chains[0] == [(0, 20, 100), (22, 40, 122)]
    assert [(400, 410, 510)] in chains


def test_align_trims_what_differs():
    a = np.arange(100, dtype=np.uint32)
    b = np.concatenate([np.arange(500, 510), np.arange(20, 50), [999], np.arange(51, 90), np.arange(600, 640)]).astype(np.uint32)
    assert op5_passages.align(a, b, [(25, 60, 15)], 50) == [(20, 90, 10, 80, 69)]


def test_runs_of_one_word_and_repeated_lines(spark):
    rng = random.Random(9)
    line = " ".join(_prose(rng, 12))
    docs = [
        (1, " ".join(_prose(rng, 40)) + " of" * 120 + " " + " ".join(_prose(rng, 30)), ""),
        (2, " ".join(_prose(rng, 80)) + " of" * 70 + " " + " ".join(_prose(rng, 9)) + " of" * 90, ""),
        (3, f"{line}\n" * 9 + " ".join(_prose(rng, 50)), ""),
        (4, " ".join(_prose(rng, 50)) + "\n" + f"{line}\n" * 6, ""),
    ]
    spans = _covered(op5_passages.repeated_passages(spark.createDataFrame(docs, SCHEMA)).collect(), 50)
    assert any(b - a >= 66 for a, b in spans[1]) and any(b - a >= 66 for a, b in spans[2])
    assert any(b - a >= 66 for a, b in spans[3]) and any(b - a >= 66 for a, b in spans[4])


def test_passages_of_common_lines(spark):
    """Three lines that are each in many texts alone are a passage of the few texts that have all of them."""
    rng = random.Random(31)
    lines = [_prose(rng, 20) for _ in range(6)]
    docs, planted = [], set()
    for d in range(160):
        text = _prose(rng, 40)
        for k in rng.sample(range(6), 6) if d < 150 else []:
            text += lines[k] + _prose(rng, 30)
        if d >= 150:
            k = d % 2 * 3
            text += lines[k] + lines[k + 1] + lines[k + 2] + _prose(rng, 30)
            planted.add(d)
        docs.append((rng.randint(0, 1 << 40) * 1000 + d, " ".join(text), "x"))
    found = op5_passages.repeated_passages(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    assert {x % 1000 for r in found for x in (r.doc_id, r.other_id)} == planted
    assert all(r.doc_id % 2 == r.other_id % 2 for r in found)


def test_every_text_with_a_passage_stands_under_its_key(spark):
    """Against brute force: all texts that share 50 words in a row are found under doc_id, and nothing agrees by less than three quarters."""
    rng = random.Random(41)
    passages = [_prose(rng, n) for n in (50, 51, 64, 130)]
    docs = []
    for d in range(120):
        text = _prose(rng, rng.randint(20, 300))
        if d % 3:
            at = rng.randint(0, len(text))
            text[at:at] = passages[d % 4]
        docs.append((d, " ".join(text), "x"))
    docs += [(500, docs[1][1], "x"), (500, docs[1][1], "x"), (501, None, "x"), (502, "", "x"), (500, docs[2][1], "tie")]
    runs = {}
    for d, text, _ in docs:
        w = (text or "").split()
        for i in range(len(w) - 49):
            runs.setdefault(tuple(w[i : i + 50]), set()).add((d, text))
    shared = {d for texts in runs.values() if len(texts) > 1 for d, _ in texts}
    found = op5_passages.repeated_passages(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    assert {r.doc_id for r in found} == shared
    assert {(r.doc_id, r.first_word, r.other_id, r.other_first) for r in found} == {(r.other_id, r.other_first, r.doc_id, r.first_word) for r in found}
    _covered(found, 50)


def test_long_gaps_are_compared_whole():
    """A gap of hundreds of words between two runs is matched by its longest common subsequence."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 9, 150).tolist(), rng.integers(0, 9, 170).tolist()
        got = op5_passages._between(a, b)
        pairs = [(i, j) for i, j in enumerate(got) if j >= 0]
        assert all(a[i] == b[j] for i, j in pairs) and all(x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert len(pairs) == row[-1]
