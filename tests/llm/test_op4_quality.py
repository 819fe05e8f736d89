"""The quality classifier: folds, held-out accuracy, odd texts, no labels."""

from __future__ import annotations

import random
import zlib

import numpy as np
from tessera.llm import op4_quality as q


def test_pooled_shares_do_not_fall():
    got = q.pooled(np.array([1.0, 3, 1, 0, 4]), np.array([4.0, 4, 4, 1, 4]))
    assert np.allclose(got, [0.25, 4 / 9, 4 / 9, 4 / 9, 1.0])
    assert len(q.pooled(np.zeros(0), np.zeros(0))) == 0


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, len(q.STATISTICS))) * 0.7
    f = q.fourier(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, :-1]
    apart = ((x[:, None] - x[None, :]) ** 2).sum(axis=2)
    assert np.abs(f @ f.T - np.exp(-apart / (2 * q.BANDWIDTH**2))).max() < 0.35


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for d in range(600):
        good = rng.random() < 0.5
        body = " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(40, 90)))
        rows.append((d, body if good else " ".join(x.upper() + "!!1" for x in body.split()[:12]) * 3, 1.0))
        labels.append((d, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = q.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {d: y for d, y, _ in labels}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_odd_texts_and_labels(spark, odd_docs, odd_rows):
    labels = spark.createDataFrame([(k, None if k % 5 == 0 else k % 2, 0) for k, _ in odd_rows if k is not None] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = q.score(odd_docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in odd_rows)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in q.score(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_empty_table(spark, no_docs):
    assert q.score(no_docs, spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_against_a_plain_fit(spark):
    """Scores equal those of one ridge and one isotonic fit over all labelled rows in memory, ties, nulls and repeated rows included."""
    import random
    import zlib

    import numpy as np
    from planted import words

    rng = random.Random(17)
    texts = {d: " ".join(words(rng, rng.randint(5, 90))) if d % 3 else "BUY!!! $$$ " * rng.randint(1, 30) for d in range(240)}
    rows = [(d, t) for d, t in texts.items()] + [(5, texts[5]), (6, texts[6]), (300, None), (301, ""), (None, texts[7])]
    marks = [(d, int(d % 3 > 0)) for d in range(240) if d % 7] + [(301, None), (None, 1)]
    docs = spark.createDataFrame([(k, t, "f", 1.0) for k, t in rows], "doc_id long, text string, fold string, score double").repartition(3)
    got = q.score(docs, spark.createDataFrame(marks, "doc_id long, quality int")).collect()

    fold = lambda k: zlib.crc32(str(k).encode()) % 3 if k is not None else -1
    label = {k: y for k, y in marks if k is not None and y is not None}
    known = [(np.array(q.statistics((t or "").encode())), label[k], fold(k)) for k, t in rows if k in label and fold(k) != 1]
    f, y, part = np.array([x for x, _, _ in known]), np.array([v for _, v, _ in known], float), np.array([p for _, _, p in known])
    fit, rest = part == 2, part != 2
    mean, spread = f[fit].mean(axis=0), f[fit].std(axis=0)
    spread[spread < 1e-9] = 1.0
    x = q.fourier(f[fit], mean, spread)
    weights = np.linalg.solve(x.T @ x + q.RIDGE * max(1.0, len(x)) * np.eye(x.shape[1]) / x.shape[1], x.T @ y[fit])
    raw = lambda a: q.fourier(a, mean, spread) @ weights
    bins = np.floor((np.clip(raw(f[rest]), -0.5, 1.5) + 0.5) / 2 * q.BINS).astype(int)
    used = np.unique(bins)
    hits = np.array([y[rest][bins == b].sum() for b in used])
    counts = np.array([(bins == b).sum() for b in used])
    level = np.array([max(min(hits[i : j + 1].sum() / counts[i : j + 1].sum() for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))])  # isotonic by its minimax formula
    wanted = sorted((str(k), round(float(np.clip(np.interp(raw(np.array([q.statistics((t or "").encode())])), (used + 0.5) / q.BINS * 2 - 0.5, level), 0, 1)[0]), 4)) for k, t in rows)
    assert [(k, s) for k, s in sorted((str(r.doc_id), round(r.score, 4)) for r in got)] == wanted
