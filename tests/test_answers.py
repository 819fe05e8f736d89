"""Answers, commands, files and type files."""

from __future__ import annotations

from pyspark.sql import functions as F
from tessera.functions import answers as A
from tessera.operators import commands as C
from tessera.sources import files, spec_files


def test_conformance(spark):
    rows = spark.createDataFrame([('{"value":["a","b","c"],"extra":1}',), ('{"other":1}',), ("no json",), (None,)], "raw string")
    got = [r[0] for r in rows.select(A.conforming(F.col("raw"), A.block_schema("list"), ["value"], {"value": 2})).collect()]
    assert got[0].value == ["a", "b"] and got[1:] == [None, None, None]


def test_salvage(spark):
    cases = {'{"a": 1, "b": "x"}': '{"a": 1, "b": "x"}', '{"a": 1, "b": "x': '{"a": 1}', '{"a": "q, \\"r"': '{"a": "q, \\"r"}', '{"a": [1, 2': None, "": None}
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, raw string")
    assert [r.s for r in rows.select("i", A.salvaged("raw").alias("s")).orderBy("i").collect()] == list(cases.values())


def test_stalls_and_attempts(spark):
    rows = spark.createDataFrame([('{"a":' + " " * 100 + "1}",), ('{"a":"' + " " * 100 + '"}',)], "raw string")
    assert [r[0] for r in rows.select(A.stalled(F.col("raw"))).collect()] == [True, False]
    calls = spark.createDataFrame([(1, 1, False, True), (1, 2, True, True), (2, 1, True, True), (2, 2, False, True), (3, 1, False, False)], "call int, attempt int, usable boolean, up boolean")
    got = A.last_attempt(calls, "call", "attempt", F.col("usable"), F.col("up"))
    assert {r.call: r.state for r in got.collect()} == {1: "ok", 2: "malformed", 3: "unavailable"}


def test_fresh_terms_and_captions(spark):
    proposed = spark.createDataFrame([("q", "Lot", 1), ("q", " lot ", 2), ("q", "batch", 3), ("q", " ", 4)], "q string, term string, n int")
    known = spark.createDataFrame([("q", "BATCH")], "q string, term string")
    assert [r.term for r in A.fresh_terms(proposed, known, "q", "term", "n").collect()] == ["Lot"]
    captions = spark.createDataFrame([("1", "a"), ("5", "b"), ("x", "c"), ("2", " ")], "n string, caption string")
    assert [r.caption for r in A.captions_kept(captions, "n", "caption", F.lit(4)).collect()] == ["a"]
    assert A.free_key("nowhere", {"nowhere", "_nowhere"}) == "__nowhere"


def test_commands_round_trip(spark):
    raw = spark.createDataFrame([(1, '[{"kind":"ask","ask":"Why?"},{"kind":"pattern","pattern":"x+"}]')], "q int, c string")
    again = C.dumped(C.parsed(raw, "q", "c"), "q").first().commands
    back = spark.createDataFrame([(1, again)], "q int, c string")
    assert [(r.kind, r.ask, r.pattern) for r in C.parsed(back, "q", "c").orderBy("command_no").collect()] == [("ask", "Why?", None), ("pattern", None, "x+")]


def test_files(spark, tmp_path):
    for name, content in {"a.txt": b"# T\n\ntext", "b.csv": b"x,y\n1,2\n", "c.pdf": b"%PDF", "e.txt": b" \n ", "f.html": b"<p>one</p><p>two</p>", "g.eml": b"Subject: s\r\n\r\nbody one\r\n\r\nbody two", "h.docx": b"broken"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.absorbed(files.files(spark, str(tmp_path))).collect()}
    assert [u.text for u in got["a.txt"].units] == ["T", "text"] and [u.kind for u in got["b.csv"].units] == ["heading", "table_row"]
    assert [u.text for u in got["f.html"].units] == ["one", "two"] == [u.text.replace("body ", "") for u in got["g.eml"].units]
    assert got["c.pdf"].error == "no reader for this format" and got["e.txt"].error == "the file has no text" and "BadZipFile" in got["h.docx"].error


def test_empty_file(spark):
    rows = spark.createDataFrame([("d.txt", "d.txt", b"")], "path string, name string, content binary")
    assert files.absorbed(rows).first().error == "the file is empty"


def test_type_files(spark):
    text = "sections:\n- key: facts\n  blocks:\n  - key: items\n    kind: table\n    columns:\n    - {key: id}\n    - {key: when, type: date}\n  requirements:\n  - {id: r1, block: items, kind: rows}\n- key: cause\n  depends_on: [facts]\n"
    spec = spec_files.parsed(text)
    assert spec_files.parsed(spec_files.dumped(spec)) == spec
    made = spec_files.tables(spark, {"s": spec})
    assert {n: df.count() for n, df in made.items()} == {"sections": 2, "blocks": 1, "columns": 2, "edges": 1, "requirements": 1}
