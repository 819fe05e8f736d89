"""Text and value functions on table cases."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F
from tessera.functions import text as T
from tessera.functions import values as V
from tessera.functions import words as W


def apply(spark, inputs, make):
    """``make(columns...)`` over rows of inputs, in order."""
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)]
    width = len(rows[0])
    df = spark.createDataFrame(rows, ", ".join(["i int", *[f"c{k} string" for k in range(1, width)]]))
    return [r.out for r in df.select("i", make(*[F.col(f"c{k}") for k in range(1, width)]).alias("out")).orderBy("i").collect()]


def test_plain_clean(spark):
    got = apply(spark, ["a\r\nb\rc", "a b c", "x\x0cy z", "so­ft​ \x00nul\ttab", None], T.plain_clean)
    assert got == ["a\nb\nc", "a b c", "x\ny\nz", "soft nul\ttab", None]
    assert apply(spark, [g for g in got if g], T.plain_clean) == [g for g in got if g]


def test_compose_and_deaccent_only_touch_what_they_change(spark):
    df = spark.createDataFrame([(1, "über"), (2, "plain"), (3, None), (4, "ü")], "i int, t string")
    assert {r.i: r.t for r in T.with_clean(df, "t").collect()} == {1: "über", 2: "plain", 3: None, 4: "ü"}
    df = spark.createDataFrame([(1, "Straße Größe"), (2, "x²"), (3, "plain"), (4, None)], "i int, t string")
    assert {r.i: r.t for r in T.with_deaccented(df, "t").collect()} == {1: "Strasse Grosse", 2: "x2", 3: "plain", 4: None}


def test_slugs(spark):
    assert apply(spark, ["Which lot?", "!!", None, "a" * 80], T.slug) == ["which_lot", "question", "question", "a" * 60]
    assert apply(spark, ["8D report", "a long title that goes on and on and on and on and on and on and on"], T.spec_slug) == ["_8d_report", "a_long_title_that_goes_on_and_on_and_on_and_on_and_on_and"]


def test_quoted_from(spark):
    source = "The lot  was\nblocked on Monday after the test had failed twice in a row."
    cases = [("LOT was blocked", True), ("lot was released", False), ("", False), ("the lot was blocked on monday after the TEST was fine", True), ("the lot was blocked", True), (None, False)]
    assert apply(spark, [(q, source) for q, _ in cases], T.quoted_from) == [x for _, x in cases]


def test_says_no_more(spark):
    assert apply(spark, [("LOT-12", "lot 12 / a"), ("lot 13", "lot 12")], T.says_no_more) == [True, False]


def test_window(spark):
    text = "aaa bbb ccc ddd eee fff ggg hhh"
    got = apply(spark, [text], lambda c: T.window(c, F.lit(12), F.lit(15), 6))
    assert got == ["…ccc ddd eee…"]
    assert apply(spark, ["short text"], lambda c: T.window(c, F.lit(0), F.lit(5))) == ["short text"]


def test_context_prefers_paragraphs(spark):
    text = "first part\n\nsecond part here\n\nthird part"
    assert apply(spark, [text], lambda c: T.context(c, F.lit(19), F.lit(23), 12)) == ["second part here"]


@pytest.mark.parametrize(("items", "said"), [([], ""), (["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b and c")])
def test_listed(spark, items, said):
    df = spark.createDataFrame([(items,)], "x array<string>")
    assert df.select(T.listed(F.col("x"))).first()[0] == said


def test_small_text_functions(spark):
    assert apply(spark, ["- item", "3) x"], T.without_marker) == ["item", "3) x"]
    assert apply(spark, ["3. Cause", "Cause"], lambda c: T.without_number(c, F.lit(3))) == ["Cause", "Cause"]
    assert apply(spark, ["My: report/2 (ü)", "a  -  b"], T.filename) == ["My-report2-ü", "a-b"]
    assert apply(spark, ["postgres://me:pw@host/db", "file:///x"], T.redacted_url) == ["postgres://me:***@host/db", "file:///x"]
    assert apply(spark, ["true", "not_stated", "Free text"], T.answer_text) == ["Yes", "not stated", "Free text"]
    assert apply(spark, ["1"], lambda c: T.counted(c.cast("int"), "passage")) == ["1 passage"]
    assert apply(spark, ["one two  three", "", " ", None], T.word_count) == [3, 0, 0, 0]


def test_marked_merges_and_apart_skips(spark):
    got = apply(spark, ["abcabc x ABC"], lambda c: T.marked(c, F.array(F.lit("abc"), F.lit("bca"), F.lit(""))))
    assert [tuple(s) for s in got[0]] == [(0, 6), (9, 12)]
    df = spark.createDataFrame([([(0, 5), (3, 8), (5, 6)],)], "s array<struct<from:int,to:int>>")
    assert [tuple(s) for s in df.select(T.apart(F.col("s"))).first()[0]] == [(0, 5), (5, 6)]


def test_word_diff(spark):
    got = apply(spark, [("the old lot", "the new lot")], T.word_diff)[0]
    assert [(r.op, r.text) for r in got] == [("keep", "the "), ("delete", "old"), ("insert", "new"), ("keep", " lot")]


def test_dates(spark):
    cases = {"2026-09-08": date(2026, 9, 8), "8.9.2026": date(2026, 9, 8), "08/09/2026": date(2026, 9, 8), "2026/9/8": date(2026, 9, 8), "8-9-2026": date(2026, 9, 8), "8.9.26": date(2026, 9, 8), "31.2.2026": None, "on 8.9.2026 at": date(2026, 9, 8), "March 3": None, "": None}
    assert apply(spark, list(cases), V.date) == list(cases.values())


def test_numbers(spark):
    cases = {"12,05 mm": "12.05", "12.0": "12", "-3": "-3", "1.234,56": "1.234", "none": None, "12.50": "12.5"}
    assert apply(spark, list(cases), lambda c: V.number_key(V.number(c))) == list(cases.values())


def test_form_values(spark):
    options = F.array(F.lit("High"), F.lit("Low"))
    cases = [
        ("8.9.2026", "date", "2026-09-08"), ("31/2/2026", "date", "31/2/2026"), ("2026-09-08", "date", "2026-09-08"), ("1.234,56", "number", "1234.56"), ("12,5", "number", "12.5"), ("1 000", "number", "1000"),
        ("x", "boolean", "true"), ("nope", "boolean", "false"), ("high", "enum", "High"), ("mid", "enum", "mid"), ("", "number", ""), ("abc", "number", "abc"),
        ("-1.234.567,8", "number", "-1234567.8"), ("1234,5", "number", "1234.5"), ("1234.567,5", "number", "1234.567,5"), ("12.34,5", "number", "12.34,5"), ("1,2,3", "number", "1,2,3"), ("12.5", "number", "12.5"), ("1,", "number", "1,"), (",5", "number", ",5"),
        ("8-9/2026", "date", "2026-09-08"), ("1.1.26", "date", "1.1.26"), (None, "date", None), ("x", "text", "x"),
    ]
    assert apply(spark, [(a, b) for a, b, _ in cases], lambda raw, kind: V.form_value(raw, kind, options)) == [c for *_, c in cases]


def test_parses_as(spark):
    options = F.array(F.lit("a"))
    cases = [("2026-09-08", "date", True), ("20260908", "date", True), ("8.9.2026", "date", False), ("2026-02-31", "date", False), ("1e5", "number", True), ("nan", "number", True), ("1_000", "number", True), ("1,5", "number", False), ("a", "enum", True), ("b", "enum", False), ("x", "string", True)]
    cases += [("2026-W53-7", "date", True), ("2025-W53-1", "date", False), ("2020W53", "date", True), ("2026-W01", "date", True), ("2026W011", "date", True), ("2026-W00-1", "date", False), ("2026-W011", "date", False), ("2026W01-1", "date", False), ("2026-W01-8", "date", False), ("0000-W01-1", "date", False)]
    assert apply(spark, [(a, b) for a, b, _ in cases], lambda raw, kind: V.parses_as(raw, kind, options)) == [c for *_, c in cases]


def test_rows_and_confidence(spark):
    df = spark.createDataFrame([({"a": " ", "b": "false"}, {"a": "x  y"}), ({"a": "v"}, {"a": "x y", "b": ""})], "m map<string,string>, n map<string,string>")
    assert [r[0] for r in df.select(V.row_has_content(F.col("m"), F.array(F.lit("b")))).collect()] == [False, True]
    assert df.select(V.same_row(F.create_map(F.lit("a"), F.lit("x y")), F.col("n"))).collect()[0][0]
    assert apply(spark, ["0.4", "7", "-1", "high", None], V.confidence) == [0.4, 1.0, 0.0, 0.0, 0.0]


def test_language_by_frequent_words(spark):
    texts = ["the cat sat on the mat and it was not amused by the state of the house at all", "der Hund und die Katze sind nicht mit dem Auto auf der Straße und das ist gut so", "too short"]
    assert [r.code for r in apply(spark, texts, W.language)] == ["en", "de", "en"]
