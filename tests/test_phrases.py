"""Phrases and quotes in many texts against plain search."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from tessera.operators import phrases

TEXTS = [
    (1, "foo foobar, baz"), (2, "Foo\n> foobar,\n> BAZ qux"), (3, None), (4, ""), (5, "x > y >> z"), (6, "ein Straßenname aus Köln 😀 und mehr, " * 50),
    (7, "aaaa aaaa"), (8, "one two three four five six seven eight and other words than those"), (8, "one two"), (None, "no key but foo"),
]
QUOTES = ["", None, " ", "foo", "foobar", "foo foobar", "oo  fooba", "foo foobar, baz", "foobar, baz qux", ">", "> y", "y >> z", "STRASSENNAME aus", "köln 😀 und", "aa", "one two three four five six seven eight nine ten", "one two three four five six seven nine", "x", "nowhere", ">>", "> >", "ſtrassenname", "İ"]


def fold(text):
    return " ".join((text or "").split()).lower().replace("ß", "ss")


@pytest.fixture(params=[1 << 20, 60])
def blocks(request, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_CHARS", request.param)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, t string").repartition(3)


@pytest.fixture(scope="module")
def quotes(spark):
    return spark.createDataFrame(list(enumerate(QUOTES)), "q long, quote string")


def test_quoted_of_any_length(texts, quotes, blocks):
    got = sorted(map(repr, map(tuple, phrases.quoted(texts, quotes, "id", "t", quote_key="q").collect())))
    want = []
    for q, quote in enumerate(QUOTES):
        begin = " ".join(fold(quote).split()[:8])
        want += [(q, k) for k, t in TEXTS if begin and begin in fold(t)]
    assert got == sorted(map(repr, want))
    assert repr((5, 1)) in got and repr((3, 1)) in got


def test_places_of_any_length(texts, quotes, blocks):
    got = sorted(map(repr, map(tuple, phrases.quote_places(texts, quotes, "id", "t", quote_key="q").collect())))
    want = []
    for q, quote in enumerate(QUOTES):
        words = [w for w in (quote or "").split() if w != ">"]
        for k, t in TEXTS:
            m = re.search(r"[\s>]+".join(map(re.escape, words)), t or "", re.IGNORECASE) if words else None
            if m:
                want.append((q, k, m.start(), m.end()))
    assert got == sorted(map(repr, want))


def test_occurrences_as_count(spark, blocks):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ab c", k=rng.randint(0, 200))), rng.choice(["x", "y", None])) for i in range(60)]
    terms = [("".join(rng.choices("ab c", k=rng.randint(1, 4))), rng.choice(["x", "y", None])) for _ in range(40)]
    texts = spark.createDataFrame(rows, "id long, t string, lang string")
    sought = spark.createDataFrame(terms, "term string, lang string")
    got = sorted(map(tuple, phrases.occurrences(texts, sought, "id", "t").collect()))
    assert got == sorted((i, p, t.count(p)) for i, t, _ in rows for p, _ in terms if p in t)
    got = sorted(map(tuple, phrases.occurrences(texts, sought, "id", "t", by="lang").collect()))
    assert got == sorted((i, p, t.count(p)) for i, t, v in rows for p, w in terms if p in t and v == w)


def test_empty_tables(spark, texts, quotes):
    none = quotes.limit(0)
    assert phrases.quoted(texts, none, "id", "t", quote_key="q").collect() == []
    assert phrases.quote_places(texts.limit(0), quotes, "id", "t", quote_key="q").columns == ["q", "id", "char_from", "char_to"]


def test_many_phrases_take_one_pass(spark):
    """Ten thousand phrases: the time of a text does not grow with their number."""
    import time

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    text = " ".join(word() for _ in range(20_000))
    texts = spark.createDataFrame([(i, text) for i in range(8)], "id long, t string").cache()
    took = []
    for n in (100, 10_000):
        terms = spark.createDataFrame([(f"{word()} {word()}",) for _ in range(n)], "term string").cache()
        terms.count()
        phrases.occurrences(texts, terms, "id", "t").count()
        began = time.perf_counter()
        phrases.occurrences(texts, terms, "id", "t").count()
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 2


@pytest.mark.parametrize(("query", "ids"), [("quote_verification", [(1, 0), (2, 1)]), ("short_quote_verification", [(1, 0), (2, 1)])])
def test_queries_keep_sharp_s(spark, tmp_path, query, ids):
    """As their SQL, which lowers case and no more."""
    from tessera.plans.registry import QUERIES

    spark.createDataFrame([(0, "grüßx"), (1, "grüssx")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "GRÜßX"), (2, "Grüssx")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted({(r.doc_id, r.item_id) for r in QUERIES[query](spark, str(tmp_path)).collect()}) == ids
    texts, quotes = (spark.createDataFrame([(1, "ß"), (2, "ss")], f"{k} long, {t} string") for k, t in (("id", "t"), ("q", "quote")))
    pairs = lambda **how: sorted((r.q, r.id) for r in phrases.quoted(texts, quotes, "id", "t", quote_key="q", **how).collect())
    assert pairs() == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert pairs(fold=F.lower) == [(1, 1), (2, 2)]


def test_frequent_short_phrases_are_not_walked():
    """Those that stand at every other place take one search of a text each, and give the same counts."""
    texts = [("aXb" * 50 + " a longer one"), "b", ""]
    seen: list[int] = []
    sought = phrases._phrases_of("short", ["a", "xb", "a longer", "b", "a"])
    walk = sought.iter
    sought.iter = lambda text: (seen.append(1) or hit for hit in walk(text))
    assert [p for p, _ in sought.short] == ["a", "b", "xb"] and dict(sought.short)["a"] == [0, 4]
    assert [at for text in texts for _, (_, at) in sought.iter(text)] == [[2]] and len(seen) == 1
    only = phrases._phrases_of("only", ["a"])
    assert only.automaton is None and list(only.iter("aaa")) == []


def test_places_after_letters_that_fold_to_more(spark, blocks):
    """A place in the folded text is no bound where letters fold to two, or the quote has marks."""
    bodies = ["ßßßßßß  foo", "ŉ ŉ\n>foo  FOO", "  \n foo", "İİ fooı", ">foo", "x >foo bar foo", "\u2028foo\u00a0bar"]
    asked = ["foo", "foo bar", ">foo", "> foo", "ss foo", "fooi", "oo", "o"]
    texts = spark.createDataFrame(list(enumerate(bodies)), "id long, t string")
    quotes = spark.createDataFrame(list(enumerate(asked)), "q long, quote string")
    got = sorted(map(tuple, phrases.quote_places(texts, quotes, "id", "t", quote_key="q").collect()))
    want = []
    for q, quote in enumerate(asked):
        words = [re.escape(w) for w in quote.split() if w != ">"]
        found = [(q, k, re.search(r"[\s>]+".join(words), t, re.IGNORECASE)) for k, t in enumerate(bodies)]
        want += [(q, k, m.start(), m.end()) for q, k, m in found if m]
    assert got == sorted(want)
