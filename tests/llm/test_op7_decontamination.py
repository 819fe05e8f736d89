"""Benchmark items planted in documents, whole, changed and paraphrased."""

from __future__ import annotations

import random

import numpy as np

from planted import words
from tessera.llm import op7_decontamination as dc


def test_subsequence_is_the_longest():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y >= 0 else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(50):
        a, b = [rng.randint(0, 6) for _ in range(rng.randint(1, 30))], [rng.randint(-1, 6) for _ in range(rng.randint(1, 40))]
        assert dc.subsequence(a, b) == slow(a, b)


def test_planted_items(spark, odd_rows):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.randint(20, 40)))) for i in range(12)] + [(90, None), (91, "too short"), (92, "")]
    docs, planted = [(k, t, "x") for k, t in odd_rows], set()
    for d in range(40):
        text = words(rng, rng.randint(30, 300))
        if d % 2:
            item = items[d % 12]
            said = item[1].split()
            if d % 4 == 1:
                said[3], said[9] = "other", "words"
                said.insert(12, "more")
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + "," if i % 5 == 0 else w for i, w in enumerate(said)]
            planted.add((1000 + d, item[0]))
        docs.append((1000 + d, " ".join(text), "x"))
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    got = dc.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted
    assert all(r.subsequence >= dc.WITH_ANSWER and r.last_word > r.first_word for r in got)


def test_empty_tables(spark, no_docs, odd_docs):
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert dc.contaminated(no_docs, items).collect() == []
    assert dc.contaminated(odd_docs, items.limit(0)).collect() == []


def test_items_of_all_lengths_among_common_words(spark):
    """Short and long items are found whole, changed and shortened, in documents of words that all documents have."""
    rng = random.Random(21)
    common = words(rng, 400)
    lengths = [5, 7, 9, 12, 30, 64, 300, 420]
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate(lengths)]
    docs, planted = [], set()
    for d in range(160):
        text = [rng.choice(common) for _ in range(900)]
        k = d % 10
        if k < len(items):
            said = items[k][1].split()
            if d // 10 % 2:
                said = [w for i, w in enumerate(said) if i % 3 != 1]  # about two thirds, in order
            at = rng.randint(0, len(text))
            text[at:at] = said
            planted.add((d, k))
        docs.append((d, " ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = dc.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted
    for r in got:
        assert r.last_word - r.first_word <= max(64, 4 * lengths[r.item_id])


def test_recall_does_not_depend_on_the_number_of_documents(spark):
    """The same items are found when the weights are those of a much larger table with the same shares."""
    rng = random.Random(22)
    items = [(i, " ".join(words(rng, 24))) for i in range(6)]
    filler = words(rng, 300)
    terms = {w: i for i, w in enumerate(sorted({w for _, t in items for w in t.split()}))}
    item_words = [[terms[w] for w in t.split()] for _, t in items]
    index = dc.Index([k for k, _ in items], item_words, [w[-4:] for w in item_words], np.ones(len(terms)))
    texts = [[rng.choice(filler) for _ in range(200)] + t.split()[:8] + ["new"] * 4 + t.split()[12:] for _, t in items]
    ids = np.array([terms.get(w, -1) for t in texts for w in t], np.int32)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    before = dc._before(ids)
    for total in (10_000, 7_000_000):
        index.idf = np.full(len(terms), np.log((2.0 + total) / (1.0 + total / 50)))
        found = {(t, k) for lengths in dc._by_length(index) for t, k, a, b in dc._windows(lengths, ids, before, first) if dc._stretch(index, k, ids[a:b].tolist())}
        assert found == {(i, i) for i in range(len(items))}


def test_paraphrase_in_other_words(spark):
    """A corpus says the same things in two sets of words; an item retold in the other set shares the frequent words in order, and little weight."""
    rng = random.Random(33)
    frequent = words(rng, 60)
    topics = [[(f"one{t}x{i}", f"two{t}x{i}") for i in range(12)] for t in range(60)]

    def passage(t, n, which):
        return [rng.choice(frequent) if i % 5 < 3 else rng.choice(topics[t])[which(i)] for i in range(n)]

    docs = [(d, " ".join(passage(d % 60, 160, lambda i: rng.randint(0, 1)))) for d in range(900)]
    item = passage(3, 30, lambda i: 0)
    other = {a: b for pairs in topics for a, b in pairs}
    retold = [other.get(w, w) for w in item]
    docs.append((1000, " ".join(passage(8, 40, lambda i: rng.randint(0, 1)) + retold + passage(11, 40, lambda i: rng.randint(0, 1)))))
    df = {w: sum(w in set(t.split()) for _, t in docs) for w in {*item, *retold}}
    weight = lambda ws: sum(np.log((2 + len(docs)) / (1 + df[w])) ** 2 for w in ws)
    plain = weight([w for w in item if w not in other]) / np.sqrt(weight(item) * weight(retold))
    assert plain < dc.COSINE  # words and weights alone keep them apart
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = dc.contaminated(frame, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1000, 7)]
    assert got[0].cosine >= dc.LATENT


def test_groups_of_items_and_repeated_ones(spark, monkeypatch):
    """A benchmark larger than one group, equal items, short items on demand, extra columns that clash, and null keys."""
    rng = random.Random(34)
    monkeypatch.setattr(dc, "GROUP_BYTES", 500)
    items = [(i, " ".join(words(rng, 25)), "x") for i in range(9)] + [(9, "hapax legomenon duo", "x"), (10, None, None)]
    items.append((20, items[4][1], "y"))
    docs = [(d, " ".join(words(rng, 90)), d) for d in range(30)]
    docs += [(None, items[4][1], 1), (100, docs[0][1] + " " + items[7][1].upper(), 1), (100, "other", 1), (101, "said Hapax, legomenon: duo!", 1)]
    benchmark = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    frame = spark.createDataFrame(docs, "doc_id long, text string, item long")
    found = lambda **more: {(r.doc_id, r.item_id) for r in dc.contaminated(frame, benchmark, **more).collect()}
    assert found() == {(None, 4), (None, 20), (100, 7)}
    assert found(least_words=3) == {(None, 4), (None, 20), (100, 7), (101, 9)}


def test_recall_against_brute_force(spark):
    """Items kept in order by six tenths or more, anywhere in a text, against a plain search of all texts for all items."""
    rng = random.Random(35)
    vocabulary = words(rng, 900)
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 50))] for _ in range(40)]
    docs = []
    for d in range(300):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))]
        if d % 2:
            said = [w for w in items[d % 40] if rng.random() < 0.8]
            at = rng.randint(0, len(text))
            text[at:at] = said
        docs.append((d, " ".join(text)))

    place = {w: i for i, w in reversed(list(enumerate(vocabulary)))}
    coded = [[place[w] for w in t] for t in items]
    truth = set()
    for d, text in docs:
        t = [place[w] for w in text.split()]
        for k, c in enumerate(coded):
            own = set(c)
            if len(own & set(t)) >= 0.6 * len(own) and any(dc.subsequence(c, t[i : i + 2 * len(c)]) >= dc.SUBSEQUENCE * len(c) for i in range(len(t)) if t[i] in own):
                truth.add((d, k))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(frame, spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")).collect()}
    assert len(truth) > 80 and len(truth & got) >= 0.98 * len(truth)


def test_space_is_fitted_on_all_texts(spark, monkeypatch):
    """Of 41,000 documents every one is decomposed."""
    given = {}
    decompose = dc.decompose
    monkeypatch.setattr(dc, "decompose", lambda texts, *more: given.update(n=texts.count()) or decompose(texts, *more))
    docs = spark.range(41_000).selectExpr("id doc_id", "concat('some words of ', id % 97, ' and ', id % 89) text")
    items = spark.createDataFrame([(1, "some words of 5 and 7")], "item_id long, text string")
    got = dc.contaminated(docs, items).where("subsequence = 1").count()
    assert given["n"] == 41_000 and got == sum(d % 97 == 5 and d % 89 == 7 for d in range(41_000))


def test_space_of_known_directions(spark, monkeypatch):
    """Words of topics of different frequency: the space has the directions of the frequent ones, however texts are dealt."""
    rng = np.random.default_rng(7)
    topics = rng.permutation(800).reshape(8, 100)
    rows = [rng.choice(topics[min(7, int(rng.exponential(2.5)))], 64) for _ in range(4000)]
    frame = spark.createDataFrame([([-1 - int(w) for w in ids],) for ids in rows], "ids array<int>")
    counts = np.stack([np.bincount(ids[half * 32 : half * 32 + 32], minlength=800) for ids in rows for half in (0, 1)]).astype(float)
    truth = np.linalg.eigh(counts.T @ counts)[1][:, ::-1][:, :8]
    monkeypatch.setattr(dc, "COMMON", 2.0)  # nothing is left out
    found = [dc.decompose(frame.repartition(n), [], np.ones(dc.FEATURES), np.zeros(0, np.int32)).basis[:800].astype(float) for n in (1, 5)]
    assert (np.linalg.norm(found[0].T @ truth, axis=0)[:4] > 0.98).all()
    assert np.abs(np.abs(found[0][:, :4]) - np.abs(found[1][:, :4])).max() < 1e-3


def test_repeated_words_count_once_before_items_are_compared(spark, monkeypatch):
    """A text that says a few words of an item over and over has no window whose words are summed for every item."""
    rng = random.Random(41)
    items = [words(rng, 30) for _ in range(5)]
    terms = {w: i for i, w in enumerate(sorted({w for t in items for w in t}))}
    item_words = [[terms[w] for w in t] for t in items]
    index = dc.Index(list(range(5)), item_words, [w[-4:] for w in item_words], np.ones(len(terms)))
    said = item_words[0][:3] * 200
    ids = np.array(said + item_words[1], np.int32)
    first = np.array([0, len(said), len(ids)])
    given, summed = dc._given, []
    monkeypatch.setattr(dc, "_given", lambda *args: summed.append(args[-3]) or given(*args))  # args[-3]: where windows begin
    found = [w for lengths in dc._by_length(index) for w in dc._windows(lengths, ids, dc._before(ids), first)]
    assert {(t, k) for t, k, _, _ in found} == {(1, 1)}
    assert min(min(b.tolist(), default=len(said)) for b in summed) >= len(said)


def test_windows_and_stretches_against_plain_counts(spark):
    """Windows and candidates by sums over different terms are those of a plain count, for texts with many repeats, empty and short ones."""
    rng = np.random.default_rng(42)
    item_words = [rng.integers(0, 90, n).tolist() for n in (5, 8, 9, 20, 33, 40)]
    index = dc.Index(list(range(6)), item_words, [w[-4:] for w in item_words], rng.uniform(0.5, 6, 90))
    texts = [rng.integers(-9, 90, n).tolist() for n in (0, 1, 7, 0, 300, 64, 65, 1000)]
    texts += [rng.choice(w, 3 * len(w)).tolist() + [-5] * 40 + w for w in item_words]
    ids, first = np.array(sum(texts, []), np.int32), np.cumsum([0] + [len(t) for t in texts])
    before = dc._before(ids)
    got, wanted = set(), set()
    for lengths in dc._by_length(index):
        got |= set(dc._windows(lengths, ids, before, first))
        for t, k, at in ((t, k, at) for t in range(len(texts)) for k in lengths.items.tolist() for at in range(0, len(texts[t]), lengths.room)):
            own, part = item_words[k], texts[t][at : at + 2 * lengths.room]
            shares = [sum(w[x] for x in own if x in part) / sum(w[x] for x in own) for w in (index.idf**2, np.ones(90))]
            if shares[0] >= dc.COSINE**2 * (1 - 1e-4) and shares[1] >= dc.WITH_ANSWER * (1 - 1e-4):
                wanted.add((t, k, first[t] + at, first[t] + at + len(part)))
    assert got == wanted and len(wanted) > 10
    row, gain = index.shares(np.arange(6), np.ones(90))
    terms = dc._Terms.of(row, ids, before)
    text = np.sort(rng.choice([7, 10, 11, 12, 13], 3000))
    low = first[text] + rng.integers(0, 1 << 30, 3000) % np.diff(first)[text]
    high, k = np.minimum(first[text + 1], low + rng.integers(5, 80, 3000)), rng.integers(0, 6, 3000)
    held = dc._holding(terms, gain, k, low, high)
    plain = [sum(x in set(ids[a:b].tolist()) for x in item_words[i]) / len(item_words[i]) for a, b, i in zip(low, high, k, strict=True)]
    assert np.abs(held - plain).max() < 1e-5
    assert set(np.flatnonzero(held >= dc.WITH_ANSWER).tolist()) <= set(dc._may_hold(terms, gain, text, k, low, high).tolist())


def test_sums_of_rows_of_all_lengths():
    rng = np.random.default_rng(43)
    table, at = rng.standard_normal((50, 7)), rng.integers(0, 50, 9000)
    begin = np.concatenate([rng.integers(0, 9000, 3000), [0, 0, 5]])
    end = np.concatenate([np.minimum(9000, begin[:-3] + rng.integers(0, 90, 3000)), [9000, 0, 5 + dc.ROWS_ADDED]])
    assert np.allclose(dc.row_sums(table, at, begin, end), [table[at[a:b]].sum(axis=0) for a, b in zip(begin, end, strict=True)])
    assert dc.row_sums(table, at, begin[:0], end[:0]).shape == (0, 7)


def test_words_of_odd_texts_and_their_numbers():
    """Texts with and without ASCII, with letters whose lower case depends on what follows or is longer, and with broken bytes."""
    plain = lambda t: dc._NO_WORD.sub("", t.decode("utf-8", "replace").lower()).encode()
    odd = ["", "Don't, STOP!", "\u039f\u0394\u039f\u03a3, \u0391\u03a3.\u0392 \u03a3!", "\u0130\u212a\u00c4 \u00fcber\u2014\u201cw\u00f6rter\u201d_x", "a\x00b\x1c\u00a0\u2003c", "\u6f22\u5b57\U0001f600 e\u0301", "x\ufffdY\u00c9"]
    for text in [t.encode() for t in odd] + [b"\xc3!\xa9 \xff Ab\xc3"]:
        assert dc.normal(text) == plain(text)
    rng = np.random.default_rng(44)
    for n in (0, 1, 2, 5000):
        terms = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        terms = np.unique(np.concatenate([terms, terms[:3] + np.uint64(1), np.array([0, 2**64 - 1] if n == 2 else [], np.uint64)]))
        names = np.concatenate([terms, terms + np.uint64(1), rng.integers(0, 1 << 64, 999, dtype=np.uint64)])
        place = {int(t): i for i, t in enumerate(terms)}
        wanted = [place.get(int(w), -1 - int(w) % dc.FEATURES) for w in names]
        assert dc.numbered(names, terms).tolist() == wanted == dc.numbered(names, terms, dc.starts_of(terms)).tolist()
