"""The language model: sums to one, counts like a plain count, beats the base on unseen texts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tessera.llm import op1_lm_scoring as lm

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [*TOKEN.findall((t or "").translate(lower)), None]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    counts = Counter(w for k, t in rows if not held(k) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    out = Counter()
    for k, t in rows:
        tokens = split(t)
        base = sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in tokens)
        out[k, held(k), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)] += 1
    return out


def test_counts_and_base(odd_docs, odd_rows):
    got = lm.score(odd_docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == plain(odd_rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    same = [r.score for r in got if r.doc_id == 307]
    assert len(same) == 2 and abs(same[0] - same[1]) < 1e-6 * abs(same[0])  # products are taken in single precision


def test_distribution_sums_to_one():
    """All outcomes after some contexts: every word with its own vectors and every shared class."""
    rng = np.random.default_rng(2)
    model = lm.Model(rng.integers(1, 50, 300 + lm.SHARED) + 1.0)
    codes = np.arange(300 + lm.SHARED)
    for context in ([model.start] * 3, [5, 299, 301], [310, 0, model.start]):
        whole = model.log_probabilities(np.tile(context, (len(codes), 1)).astype(np.int32), codes)
        assert abs(np.exp(whole).sum() - 1) < 1e-4


def test_whole_distribution_against_an_independent_computation(spark, monkeypatch):
    """Scores of one-word texts that differ in the word alone: their tokens' shares of what is left add up to one."""
    monkeypatch.setattr(lm, "VOCABULARY", 6)
    monkeypatch.setattr(lm, "HEAD", 12)
    rng = np.random.default_rng(4)
    vocabulary = [f"{chr(97 + i % 26)}{i}" for i in range(40)]
    text = lambda n: " ".join(vocabulary[min(39, int(k))] for k in rng.exponential(8, n))
    rows = [(d, text(30)) for d in range(60)] + [(d, None) for d in (900, 901)]
    fitted = {}
    packed = lm.Model.packed
    monkeypatch.setattr(lm.Model, "packed", lambda self: fitted.update(model=self) or packed(self))
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    model = fitted["model"]
    counts = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in [*(t or "").split(), None])
    import pyarrow as pa

    def token(word):
        t = lm.Tokens.of(pa.array([(word or "").encode()], pa.binary()), 0, 1)
        return int(t.names.view(np.int64)[0]), int(t.shared[0])

    about = {w: token(w) for w in counts}
    ranked = sorted(counts, key=lambda w: (w is not None, -counts[w], about[w][0]))
    code = {w: i for i, w in enumerate(ranked[:6])}
    rest = [w for w in counts if w not in code]
    for d, t in [r for r in rows if r[0] in (2, 7, 900)]:
        said, total, before = [*(t or "").split(), None], 0.0, [model.start] * 3
        for w in said:
            c = code.get(w, 6 + token(w)[1] if w else 0)
            p = model.log_probabilities(np.array([before], np.int32), np.array([c]))[0] / math.log(10)
            if c >= 6:
                same = [x for x in rest if about[x][1] == c - 6]
                once, twice = sum(counts[x] == 1 for x in same), sum(counts[x] == 2 for x in same)
                cut = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
                n = sum(counts[x] for x in same)
                shares = [(counts[x] - cut) / n for x in same] + [cut * len(same) / n]
                assert not same or abs(sum(shares) - 1) < 1e-9
                p += math.log10((counts[w] - cut) / n if counts[w] else cut * len(same) / n) if same else 0.0
            total += p
            before = [c, *before[:2]]
        assert abs(total - got[d].score) < 1e-3 * abs(total), d


def test_ties_and_repeated_rows_score_alike(spark):
    rows = [(1, "b a", 1), (1, "b a", 1), (3, "a b", 2), (4, "a b", 2), (None, "a b", 3)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, word long")).collect()
    assert len(got) == 5 and len({round(r.score, 4) for r in got if r.doc_id == 1}) == 1
    assert len({round(r.score, 4) for r in got if r.doc_id != 1}) == 1
    assert all(r.n_tokens == 3 for r in got)


def test_vectors_are_learned_with_sampled_noise():
    """Steps raise the likelihood of what follows what, on a vocabulary of hundreds of words in several classes."""
    rng = np.random.default_rng(8)
    n = 400
    counts = np.full(n + lm.SHARED, 20.0)
    model = lm.Model(counts)
    last = rng.integers(0, n, 20000).astype(np.int32)
    examples = np.column_stack([last, rng.integers(0, n, (20000, 2)), (last * 7 + rng.integers(0, 3, 20000)) % n]).astype(np.int32)
    before = model.log_probabilities(examples[:2000, :3], examples[:2000, 3]).mean()
    for k in range(6):
        model.stepped(examples, 0.3, np.random.default_rng(k))
    after = model.log_probabilities(examples[:2000, :3], examples[:2000, 3]).mean()
    assert after > before + 1.0 and before > -math.log(n + lm.SHARED) - 0.3


def test_empty_table(no_docs):
    assert lm.score(no_docs).collect() == []


def test_learns_order(spark):
    """In a language where each word is followed by one other, the model finds held-out texts likelier than frequencies do."""
    ring = [f"w{i}x{chr(97 + i)}" for i in range(20)]
    rows = [(d, " ".join(ring[(d + i) % 20] for i in range(60)), "x") for d in range(60)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, other string")).where("held_out").collect()
    assert got and sum(r.score for r in got) > 0.7 * sum(r.base_score for r in got)


@pytest.mark.parametrize("groups", [1, 5])
def test_scores_do_not_depend_on_the_layout(spark, monkeypatch, groups, folder="/root/testdata/sf0.001"):
    """One, four and sixty-four partitions give the same model, whether its examples are one group or several."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60).select("doc_id", "text").cache()
    tokens = sum(len((r.text or "").split()) + 1 for r in docs.collect())
    monkeypatch.setattr(lm, "GROUP", tokens // (lm.SHARE * groups))
    monkeypatch.setattr(lm, "LEVEL", 2)
    found = []
    for parts in (1, 4, 64):
        rows = lm.score(docs.repartition(parts)).collect()
        found.append({r.doc_id: (r.n_tokens, r.n_known, r.score) for r in rows})
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        for k, (n, known, score) in other.items():
            assert (n, known) == found[0][k][:2] and score == pytest.approx(found[0][k][2], rel=1e-6)


def test_every_training_token_is_learned_from_once(spark, odd_docs, odd_rows, monkeypatch):
    """The examples of all rounds and groups are the tokens of the training texts, each with the three before it."""
    import pyarrow as pa

    monkeypatch.setattr(lm, "PIECE", 64)
    monkeypatch.setattr(lm, "GROUP", 500)
    given = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda pieces, counts: given.update(pieces=pieces, model=lm.Model(counts)) or train(pieces, counts))
    tokens = lm.score(odd_docs).first().train_tokens
    rows = given["pieces"].toArrow()
    assert len({(r["group"], r["round"]) for r in rows.to_pylist()}) > 2 * lm.SHARE
    found = Counter(tuple(x) for x in lm.examples_of(rows).tolist())
    assert sum(found.values()) == tokens
    start, lengths = given["model"].start, Counter()
    for k, t in odd_rows:
        if k is None or zlib.crc32(str(k).encode()) % 7 != 2:
            lengths[min(2, len(lm.Tokens.of(pa.array([(t or "").encode()], pa.binary()), 0, 1).names) - 1)] += 1
    assert sum(n for (a, *_), n in found.items() if a == start) == sum(lengths.values())  # a first token for each text, even where it is cut
    assert sum(n for (_, b, *_), n in found.items() if b == start) == sum(n * (1 + (k > 0)) for k, n in lengths.items())


def test_words_of_a_class_are_scored_together(monkeypatch):
    """A softmax for each block of tokens and each class, not for each class of every block; and the same probabilities."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(lm, "TOKENS_AT_ONCE", 256)
    model = lm.Model(rng.integers(1, 50, 1000 + lm.SHARED) + 1.0)
    codes = rng.integers(0, 1000 + lm.SHARED, 4096)
    context = rng.integers(0, 1000 + lm.SHARED + 1, (4096, lm.CONTEXT))
    sizes, softmax = [], lm._log_softmax
    monkeypatch.setattr(lm, "_log_softmax", lambda z, *more: sizes.append(len(z)) or softmax(z, *more))
    got = model.log_probabilities(context, codes)
    assert len(sizes) <= 4096 // 256 + sum(-(-n // 256) for n in np.bincount(model.class_of[codes])[: model.blocks]) and max(sizes) <= 256
    of_class, class_bias, of_word, word_bias = (p.astype(np.float64) for p in model.parts[2:])
    r = model.predicted(context).astype(np.float64)
    shares = lambda z: np.log(np.exp(z) / np.exp(z).sum(axis=1, keepdims=True))
    want = shares(r @ of_class.T + class_bias)[np.arange(4096), model.class_of[codes]]
    for i in np.flatnonzero(codes < model.own):
        mine = np.flatnonzero(model.class_of[: model.own] == model.class_of[codes[i]])
        want[i] += shares((r[i] @ of_word[mine].T + word_bias[mine])[None])[0, codes[i] - mine[0]]
    assert np.allclose(got, want, atol=1e-4) and lm.TOKENS_TOGETHER >= 16 * lm.CLASS_WORDS
