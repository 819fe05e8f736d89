"""Attachments to any depth, repeats, and mails cut into paragraphs with their authors."""

from __future__ import annotations

from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F
from tessera.operators import absorb, language
from tessera.sources import mail


def letter(subject, sender, body, *attached):
    m = EmailMessage()
    if sender:
        m["From"] = sender
    m["Subject"] = subject
    m["Date"] = "Mon, 2 Mar 2026 10:00:00 +0100"
    m.set_content(body)
    for a in attached:
        if isinstance(a, EmailMessage):
            m.add_attachment(a)
        else:
            name, data = a
            m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return m


CSV = b"name,value\na,1\nb,2\n"
INNER = letter("inner", "Ann <ann@inner.example>", "Deep words.", ("table.csv", CSV), ("broken.docx", b"no zip"))
MIDDLE = letter("middle", None, "Second words.\n\nA second paragraph.\n-- \nAnn\nsigned", INNER, ("note.txt", b"a note"))
OUTER = letter("outer", '"Bob" <bob@intranet>', "First words.\n\nAm 3.4.2025 schrieb Cleo <cleo@far.example>:\n> Old words\n> go on.\n>\n> Mo\u0308re.", MIDDLE, ("note.txt", b"a note"), ("empty.txt", b""))


@pytest.fixture(scope="module")
def sources(spark):
    files = [("c1", "a.eml", "a.eml", bytes(OUTER)), ("c1", "b.csv", "b.csv", CSV), ("c2", "z.eml", "z.eml", bytes(MIDDLE)), (None, "x.bin", "x.bin", b"??"), ("c3", "n.txt", "n.txt", None), ("c4", "p.txt", "p.txt", b"same"), ("c4", "q.txt", "q.txt", b"same"), ("c5", "p.txt", "r.txt", b"same")]
    df = spark.createDataFrame(files, "case string, path string, name string, content binary").withColumn("status", F.lit("clash")).repartition(3)
    return absorb.absorb(df).cache()


def test_every_depth_is_opened(sources):
    got = {(r.case, r.path): (r.depth, r.parent, r["format"], r.status, r.sender) for r in sources.collect()}
    assert got == {
        ("c1", "a.eml"): (0, None, "mail", "parsed", "bob@intranet"),
        ("c1", "b.csv"): (0, None, "csv", "parsed", None),
        ("c1", "a.eml!0"): (1, "a.eml", "mail", "parsed", "bob@intranet"),
        ("c1", "a.eml!1"): (1, "a.eml", "text", "parsed", "bob@intranet"),
        ("c1", "a.eml!2"): (1, "a.eml", "text", "failed", "bob@intranet"),
        ("c1", "a.eml!0!0"): (2, "a.eml!0", "mail", "parsed", "ann@inner.example"),
        ("c1", "a.eml!0!1"): (2, "a.eml!0", "text", "repeat", "bob@intranet"),
        ("c1", "a.eml!0!0!0"): (3, "a.eml!0!0", "csv", "repeat", "ann@inner.example"),
        ("c1", "a.eml!0!0!1"): (3, "a.eml!0!0", "docx", "failed", "ann@inner.example"),
        ("c2", "z.eml"): (0, None, "mail", "parsed", None),
        ("c2", "z.eml!0"): (1, "z.eml", "mail", "parsed", "ann@inner.example"),
        ("c2", "z.eml!1"): (1, "z.eml", "text", "parsed", None),
        ("c2", "z.eml!0!0"): (2, "z.eml!0", "csv", "parsed", "ann@inner.example"),
        ("c2", "z.eml!0!1"): (2, "z.eml!0", "docx", "failed", "ann@inner.example"),
        (None, "x.bin"): (0, None, "", "failed", None),
        ("c3", "n.txt"): (0, None, "text", "failed", None),
        ("c4", "p.txt"): (0, None, "text", "parsed", None),
        ("c4", "q.txt"): (0, None, "text", "repeat", None),
        ("c5", "p.txt"): (0, None, "text", "parsed", None),
    }


def test_contents_are_read_once(spark, monkeypatch):
    """Equal contents of any case and level are read once."""
    seen = []
    real = absorb.files.read
    monkeypatch.setattr(absorb.files, "read", lambda df, **k: seen.append(df.count()) or real(df, **k))
    rows = [(f"c{i}", f"{i}.eml", f"{i}.eml", bytes(MIDDLE)) for i in range(20)] + [("c0", "t.csv", "t.csv", CSV)]
    got = absorb.absorb(spark.createDataFrame(rows, "case string, path string, name string, content binary"))
    assert got.count() == 20 * 5 + 1 and seen == [2, 2, 1]
    assert got.where("status = 'repeat'").count() == 1


def test_units_know_their_authors(sources):
    units = {r.path: [(u.kind, u.text, u.sender, u.sender_domain, str(u.sent_on or ""), u.path) for u in r.units or []] for r in sources.where("case = 'c1'").collect()}
    assert units["a.eml"] == [
        ("message", "First words.", "bob@intranet", "intranet", "", ["outer"]),
        ("message", "Old words go on. Möre.", "cleo@far.example", "far.example", "2025-04-03", ["outer"]),
    ]
    assert [u[1] for u in units["a.eml!0"]] == ["Second words.", "A second paragraph."]
    assert units["a.eml!0!1"] == [] and len(units["b.csv"]) == 3


def test_language_and_passages(spark, sources):
    told = absorb.with_language(sources, "path").where("status = 'parsed'")
    assert {r.code for r in told.collect()} == {"en"}
    texts = spark.createDataFrame([("en", "words of the first and second kind, more words"), ("de", "wörter und sätze von der art")], "lang string, t string")
    model = language.train(language.trigrams(texts, "t", "lang"))
    assert absorb.with_language(sources.where("case = 'c1'"), "path", model).count() == 9
    cut = absorb.passages(sources.where("case = 'c1'")).collect()
    assert {r.path for r in cut} and all(r.text and (r.sender is None or "@" in r.sender) for r in cut)


def test_nothing(spark):
    none = spark.createDataFrame([], "case string, path string, name string, content binary")
    assert absorb.absorb(none).collect() == []


def test_sign_off(spark):
    cases = {"a\n-- \nb": "a\n", "a -- b": "a -- b", "x\nSent from my phone\ny": "x\n", "Diese E-Mail enthält vertrauliche Daten": "", "no end": "no end", "_____\nz": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.s for r in df.withColumn("s", mail.signed_off(F.col("t"))).collect()} == cases
    named = spark.createDataFrame([("From: Ann <ann@intranet>",), ("x <a b@c>",), ("From: bob@example.org",)], "t string").select(mail.sender(F.col("t"))["address"]).collect()
    assert [r[0] for r in named] == ["ann@intranet", None, "bob@example.org"]
