"""Readers: bytes, headings, delimited text, mails, pages, Word files."""

from __future__ import annotations

import io
import zipfile
from datetime import date

from pyspark.sql import functions as F
from tessera.sources import mail, office, pages, plain


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c"))).first()[0]


def test_formats(spark):
    rows = spark.createDataFrame([("a.MD", None), ("x", "text/csv"), (".hidden", "image/png"), ("b.tar.gz", None)], "n string, m string")
    got = [r[0] for r in rows.select(plain.source_format(F.col("n"), F.col("m"))).collect()]
    assert got == ["text", "csv", "image", None]


def test_decoding(spark):
    assert one(spark, "grün".encode(), plain.decoded, "binary") == "grün"
    assert one(spark, "grün „5 €“".encode("cp1252"), plain.decoded, "binary") == "grün „5 €“"


def test_text_units(spark):
    text = "intro\n\n# One\nline a\nline b\n\n## Two\n\npara\n# Three ##\n#nothing\n#"
    got = [(u.kind, u.text, u.path) for u in one(spark, text, plain.text_units)]
    assert got == [("text", "intro", []), ("heading", "One", []), ("text", "line a\nline b", ["One"]), ("heading", "Two", ["One"]), ("text", "para", ["One", "Two"]), ("heading", "Three", []), ("text", "#nothing\n#", ["Three"])]


def test_csv_units(spark):
    got = [(u.kind, u.text) for u in one(spark, 'lot,size,\nA1,"3,5",x\nA2,,\n', plain.csv_units)]
    assert got == [("heading", "lot · size · col3"), ("table_row", "lot: A1 · size: 3,5 · col3: x"), ("table_row", "lot: A2")]
    broken = [(u.kind, u.text) for u in one(spark, 'lot,size\n5" bolt,2', plain.csv_units)]
    assert broken == [("heading", "lot · size"), ("table_row", 'lot: 5" bolt · size: 2')]
    assert [u.kind for u in one(spark, "only one line", plain.csv_units)] == ["text"]


def test_pasted_rows(spark):
    columns = {"id": "Item no.", "when": "Due date", "who": "Owner"}
    paste = lambda text: one(spark, text, lambda c: plain.pasted_rows(c, columns))
    assert paste("Due date\tITEM NO\n8.9.2026\t7\n\t\n") == [{"id": "7", "when": "8.9.2026", "who": ""}]
    assert paste('1,"a, b",me\n2,x') == [{"id": "1", "when": "a, b", "who": "me"}, {"id": "2", "when": "x", "who": ""}]


def test_page_paragraphs(spark):
    assert one(spark, "The mea-\nsurement NW-\nLL was\ndone.\n\nNext", plain.page_paragraphs) == ["The measurement NW-LL was done.", "Next"]


def test_mail_headers(spark):
    got = one(spark, 'From: "Ann B" <Ann.B@Example.org>', mail.sender)
    assert (got.address, got.name) == ("ann.b@example.org", "Ann B")
    assert one(spark, "<a@b.example>.", mail.domain_of) == "b.example" and one(spark, "nobody", mail.domain_of) is None
    assert one(spark, "Am 8.9.2026 schrieb x:", mail.loose_date) == date(2026, 9, 8)
    assert one(spark, "Am 31.2.2026 (2026-02-01)", mail.loose_date) is None
    assert one(spark, "> > quoted\n>\n> more", mail.unquoted) == "quoted more"


def test_replies(spark):
    body = "thanks\n\nOn 2026-09-08 Bob <bob@x.org> wrote:\n> older text\n> On 2026-09-01 Cy <cy@y.org> wrote:\n>> oldest"
    got = mail.replies(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body").orderBy("reply_no").collect()
    assert [(r.reply_no, r.sender, r.sent_on) for r in got] == [(0, None, None), (1, "bob@x.org", date(2026, 9, 8)), (2, "cy@y.org", date(2026, 9, 1))]
    assert got[1].text == "> older text"


def test_parsed_mail(spark):
    raw = b"From: A <a@x.org>\r\nSubject: Hi\r\nMIME-Version: 1.0\r\nContent-Type: text/html\r\n\r\n<p>One</p><script>no</script><p>Two</p>"
    got = mail.parsed(spark.createDataFrame([(1, raw), (2, None)], "id int, c binary"), "id", "c").orderBy("id").collect()
    assert got[0].subject == "Hi" and got[0].body == "One\n\nTwo" and got[0].attachments == []
    assert got[1].subject is None


def test_pages(spark):
    html = "<html><head><title>t</title></head><body><h1>A &amp; B</h1><p>x<br>y</p><table><tr><td>1</td><td>2</td></tr></table><style>p{}</style></body></html>"
    assert pages.page_text(html).split("\n\n")[:2] == ["A & B", "x\ny"]
    assert pages.page_text("") == "" and pages.page_text(None) is None
    assert one(spark, html, pages.plain) == "t A & B x y 1 2"


def word_file():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda text, style=None: f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    body = p("Report", "Heading1") + p("Some text") + p("Cause", "Heading2") + f"<w:tbl>{row('id', 'name')}{row('1', 'bolt')}</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_word_files(spark):
    got = office.parsed(spark.createDataFrame([(1, word_file()), (2, b"broken")], "id int, c binary"), "id", "c").orderBy("id").collect()
    assert [(u.kind, u.text, u.path) for u in got[0].units] == [("heading", "Report", []), ("text", "Some text", ["Report"]), ("heading", "Cause", ["Report"]), ("table_row", "id: 1 · name: bolt", ["Report", "Cause"])]
    assert got[1].units is None and "BadZipFile" in got[1].error


def test_scans(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", ""), ("b", "enough text here"), ("c", None)], "s string, t string")
    assert {r.s: r.scan for r in plain.is_scan(rows, "s", "t").collect()} == {"a": True, "b": False, "c": True}


def test_long_texts_are_read_in_one_pass(spark):
    import time

    from tessera.functions import text as T
    from tessera.operators import patterns

    n = 16000
    text = "".join(f"# T{i}\n\npart {i} a@b.de\n\n" for i in range(n))
    body = "".join(f"line {i}\nFrom: x{i}@y.org\n" for i in range(n))
    df = spark.createDataFrame([(1, text, body), (2, None, None)], "id int, t string, b string")
    began = time.time()
    units = df.select("id", F.size(plain.text_units("t")).alias("n")).collect()
    cut = mail.replies(df, "id", "b").count()
    hits = patterns.native_hits(df.select("id", "t"), "t", r"a@b\.de").select("value", "char_from", "char_to").collect()
    spans = df.where("id = 1").select(F.size(T.marked("t", F.array(F.lit("A@B.DE")))).alias("n")).first()
    assert {r.id: r.n for r in units}[1] == 2 * n and cut == n and len(hits) == n and spans.n == n
    assert all(text[h.char_from : h.char_to] == h.value for h in hits)
    assert time.time() - began < 40
