"""A language's model counts the trigrams of whole texts."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest
from tessera.operators import language
from tessera.plans import documents, registry

LONG = "Der Anfang ist lang, 12 Wörter und mehr.\n\n " * 700 + "zyx qqq wvu 😀 Ünde"
ROWS = [(2, "de", LONG), (4, "en", "the end of a short one"), (6, "en", "word " * 9000), (8, None, LONG), (10, "de", ""), (12, "de", " x "), (3, "de", LONG), (5, "de", "a" * 20_000 + " zyx" * 9000)]


def plain(text):
    s = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    return [s[i : i + 3] for i in range(len(s) - 2)]


def test_texts_are_counted_to_their_end(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, lang string, text string").repartition(3)
    got = {(r.lang, r.gram): r.n for r in language.trigrams(df, "text", "lang").collect()}
    assert got == dict(Counter((lang, g) for _, lang, t in ROWS if lang for g in plain(t)))
    assert got["de", "qqq"] == 2


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_long_texts_are_counted_in_stretches(monkeypatch, stretch):
    monkeypatch.setattr(language, "STRETCH", stretch)
    texts = ["", "  ", " a ", " ab cd ", " abc " * 100, LONG]
    parts = [p.tolist() for p in language._stretches(texts)]
    assert [c for p in parts for c in p] == [c for t in texts for c in language.codes(t).tolist()]
    assert all(0 < len(p) < 2 * stretch for p in parts)


def test_model_and_languages_as_their_sql(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for query in (documents.language_model, documents.language_of):
        want = con.sql(registry.ORACLES[query.__name__])
        names = want.columns
        assert sorted(map(repr, (tuple(r[c] for c in names) for r in query(spark, str(tmp_path)).collect()))) == sorted(map(repr, want.fetchall()))
    assert "qqq" in {r.gram for r in documents.language_model(spark, str(tmp_path)).collect()}
    assert "substr(body, 1, 20000)" not in registry.ORACLES["language_model"] and "substr(body, 1, 20000)" in registry.ORACLES["language_of"]
