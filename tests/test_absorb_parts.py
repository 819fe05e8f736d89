"""Reading what a level has: dealt over tasks, and by the readers of formats that occur."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from tessera.operators import absorb
from tessera.sources import files


def test_few_large_contents_are_dealt_over_tasks(spark, monkeypatch):
    """Mails are few bytes for the time they take: Spark would put all of these in one task."""
    seen, real = [], absorb.files.read

    def read(found, **options):
        seen.append((found.select(F.spark_partition_id()).distinct().count(), set(options["formats"])))
        return real(found, **options)

    monkeypatch.setattr(absorb.files, "read", read)
    body = lambda i: f"From: a{i}@intranet\nSubject: s{i}\n\n" + "some words here\n" * 90_000
    rows = [("c", f"{i}.eml", f"{i}.eml", body(i).encode()) for i in range(8)]
    got = absorb.absorb(spark.createDataFrame(rows, "case string, path string, name string, content binary").coalesce(1)).select("path", "status", "sender").collect()
    assert {tuple(r) for r in got} == {(f"{i}.eml", "parsed", f"a{i}@intranet") for i in range(8)}
    (tasks, formats), *more = seen
    assert tasks > 1 and formats == {"mail"} and not more


def test_formats_that_occur_are_enough(spark):
    rows = [("a.txt", b"words"), ("b.csv", b"a,b\n1,2\n"), ("c.eml", b"Subject: x\n\nbody"), ("d.html", b"<p>page</p>"), ("e.eml", b""), ("f.bin", b"??"), ("g.docx", b"no zip")]
    df = spark.createDataFrame(rows, "path string, content binary").withColumn("name", F.col("path"))
    every = {r.path: r for r in files.read(df).collect()}
    assert len(every) == 7
    for formats, names in ((["text", "csv"], "ab"), (["mail"], "ce"), (["html", ""], "df"), (["docx"], "g")):
        some = df.where(F.substring("path", 1, 1).isin(*names))
        assert {r.path: r for r in files.read(some, formats=formats).collect()} == {p: r for p, r in every.items() if p[0] in names}


def test_texts_are_composed_wherever_lists_begin():
    class Rows:
        columns, schema = ["path", "units"], None

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    unit = pa.struct([("kind", pa.string()), ("text", pa.string()), ("path", pa.list_(pa.string()))])
    made = lambda e: [None, [{"kind": "k", "text": f"M{e}re", "path": None}], [], [{"kind": None, "text": None, "path": []}, {"kind": "k", "text": "a", "path": [f"{e}", None]}]]
    table = lambda e: pa.RecordBatch.from_arrays([pa.array(list("abcd")), pa.array(made(e), pa.list_(unit))], ["path", "units"])
    for begin in range(4):
        got = [r for b in files._composed(Rows())(iter([table("o\u0308").slice(begin)])) for r in b.to_pylist()]
        assert got == table("\u00f6").slice(begin).to_pylist()
