"""Languages by trigrams: counts against plain ones, and how many held-out texts are told right."""

from __future__ import annotations

import math
import os
import re
from collections import Counter

import pytest
from tessera.functions import words
from tessera.operators import language

FOLDER = os.environ.get("TESSERA_TEST_DIR", "/root/testdata/sf0.001")
ROWS = [
    (1, "en", "The cat and the dog were not in the house when the rain came over the hills."), (2, "de", "Der Hund und die Katze waren nicht im Haus, als der Regen über die Hügel kam."),
    (3, None, "sans langue"), (4, "en", None), (5, "fr", ""), (6, "fr", "Le chat et le chien n'étaient pas dans la maison quand la pluie est venue 😀 1234."), (12, "fr", "Le chat"), (7, "el", "Η γάτα και ο σκύλος"),
]


def plain(text):
    s = " " + " ".join(re.findall(r"[^\W\d_]+", " ".join((text or "").split())[:20000].lower())) + " "
    return [s[i : i + 3] for i in range(len(s) - 2)]


@pytest.mark.parametrize("held", [1 << 20, 5])
def test_trigrams_as_plain_counts(spark, monkeypatch, held):
    monkeypatch.setattr(language, "HELD", held)
    df = spark.createDataFrame(ROWS, "id long, lang string, t string").repartition(3)
    got = {(r.lang, r.gram): r.n for r in language.trigrams(df, "t", "lang").collect()}
    assert got == dict(Counter((lang, g) for _, lang, t in ROWS if lang for g in plain(t)))


def test_model_and_shares_as_plain(spark, monkeypatch):
    monkeypatch.setattr(language, "KNOWN", 40)
    df = spark.createDataFrame(ROWS, "id long, lang string, t string")
    model = language.train(language.trigrams(df, "t", "lang"))
    weights = {(r.lang, r.gram): r.weight for r in model.collect()}
    counts = Counter((lang, g) for _, lang, t in ROWS if lang for g in plain(t))
    total = Counter()
    for (_, g), n in counts.items():
        total[g] += n
    known = sorted(total, key=lambda g: (-total[g], g))[:40]
    langs = sorted({lang for lang, g in counts if g in known})
    of = {x: sum(counts[x, g] for g in known) + 40 for x in langs}
    want = {(x, g): round(1e6 * math.log((counts[x, g] + 1) / of[x])) for x in langs for g in [*known, ""] if counts[x, g] or not g}
    assert weights == want
    texts = spark.createDataFrame([(k, t) for k, _, t in ROWS] + [(9, "x" * 59), (10, "12345 " * 20), (11, ROWS[0][2] * 3000)], "id long, t string")
    for r in language.detect(texts, model, "id", "t").collect():
        body = {9: "x" * 59, 10: "12345 " * 20, 11: ROWS[0][2] * 3000}.get(r.id) or next(t for k, _, t in ROWS if k == r.id)
        grams = [g for g in plain(body) if g in known]
        if len(" ".join((body or "").split())) < words.LEAST_CHARS or not grams:
            assert (r.code, r.share) == ("en", 0.0)
            continue
        sums = {x: sum(weights.get((x, g), weights[x, ""]) for g in grams) for x in langs}
        best = min(langs, key=lambda x: (-sums[x], x))
        assert r.code == best and r.share == round(1 / sum(math.exp((v - sums[best]) / 1e6) for v in sums.values()), 3)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, lang string, t string")
    model = language.train(language.trigrams(none, "t", "lang"))
    assert model.collect() == []
    assert [tuple(r)[1:] for r in language.detect(spark.createDataFrame([(1, "a " * 50)], "id long, t string"), model, "id", "t").collect()] == [("en", 0.0)]
    assert language.detect(none, model, "id", "t").collect() == []


def test_held_out_texts_are_told_right(spark, folder="/root/testdata/sf0.01"):
    """Above 0.98 of the held-out documents that are long enough; the rest is junk without words."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("lang is not null")
    model = language.train(language.trigrams(docs.where("doc_id % 2 = 0"), "text", "lang"))
    held = docs.where("doc_id % 2 = 1")
    got = held.join(language.detect(held, model, "doc_id", "text"), "doc_id").where("share > 0").selectExpr("count(*) n", "count_if(code = lang) right").first()
    assert got.n > 300 and got.right > 0.98 * got.n, got


def test_stop_words():
    assert set(words.SUPPORTED) - set(words.STOP_WORDS) == {"zh", "ko"}
    assert words.stop_words("xx") == words.STOP_WORDS["en"] and words.stop_words(None) == words.STOP_WORDS["en"] and words.stop_words("zh") == ()
    assert all(len(set(v)) == len(v) and all(w == w.lower() for w in v) for v in words.STOP_WORDS.values())
