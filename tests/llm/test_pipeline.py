"""The pipeline: each stage keeps what it should, on its own input."""

from __future__ import annotations

import random

import corpus_pipeline as cp
import pytest
from planted import words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    out = str(tmp_path_factory.mktemp("tables"))
    texts = {d: " ".join(words(rng, rng.randint(60, 160))) for d in range(80)}
    texts |= {100 + d: "BUY NOW!!! $$$ " * 20 + "X" * d for d in range(40)}
    near = texts[3].split()
    near[50] = "changed"
    item = " ".join(words(rng, 30))
    texts |= {200: texts[3], 201: " ".join(near), 202: " ".join(words(rng, 90)) + " " + item, 203: texts[5] + " " + texts[6] + " password = hunter2hunter2 end", 204: None, 205: ""}
    rows = [(d, t, "en", "s", len(t or "")) for d, t in texts.items()] + [(None, texts[7], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{out}/documents.parquet")
    labels = [(d, 1, 0) for d in range(80)] + [(100 + d, 0, 0) for d in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert [name for name, _ in cp.STAGES][0].startswith("quality") and len(cp.STAGES) == 5

    kept = cp.quality(spark, docs, folder)
    assert kept.columns == COLUMNS and set(range(80)) <= ids(kept) and not ids(kept) & set(range(100, 140))

    one = cp.near_duplicates(spark, docs.where("doc_id not between 100 and 140 or doc_id is null"), folder)
    assert one.columns == COLUMNS and {3, 7} <= ids(one) and not ids(one) & {200, 201, None}  # the row without a key repeats 7
    assert {204, 205, 202, 203} <= ids(one)

    clean = cp.decontamination(spark, docs, folder)
    assert clean.columns == COLUMNS and ids(docs) - ids(clean) == {202}

    safe = cp.secrets(spark, docs, folder)
    assert safe.columns == COLUMNS and safe.count() == docs.count()
    texts = {r.doc_id: r for r in safe.collect()}
    assert "hunter2" not in texts[203].text and texts[203].text.endswith("[secret] end") and texts[203].n_chars == len(texts[203].text)
    assert texts[204].text is None and texts[205].text == ""


def test_rows_of_one_key_and_rows_without_one(spark, folder):
    """Repeated keys are judged row by row, one row of each group stays, and clashing columns stay as they are."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, row int, copy long"
    bad, item = texts[120], texts[202]
    rows = [(1, texts[1]), (1, bad), (1, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[9]), (9, texts[9]), (7, texts[4]), (7, item), (8, None), (8, None)]
    frame = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "d", 5, 6) for k, t in rows], schema).repartition(3)
    shown = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())

    more = docs.where("doc_id not in (1, 204, 205)").selectExpr("*", "'d' as digest", "5 as row", "cast(6 as long) as copy")
    kept = cp.quality(spark, frame.unionByName(more), folder)
    assert kept.columns == frame.columns
    assert ("1", bad) not in shown(kept) and shown(kept).count(("1", texts[1])) == 2
    one = cp.near_duplicates(spark, frame, folder)
    assert one.columns == frame.columns
    assert shown(one) == sorted([("1", texts[1]), ("1", bad), ("None", texts[2]), ("9", texts[9]), ("7", texts[4]), ("7", item), ("8", ""), ("8", "")])
    clean = cp.decontamination(spark, frame, folder)
    assert clean.columns == frame.columns and shown(clean) == sorted((str(k), t or "") for k, t in rows if t != item)
    assert {(r.digest, r.row, r.copy) for r in clean.collect()} == {("d", 5, 6)}


def test_run(spark, folder):
    got = {r.doc_id: r for r in cp.run(spark, folder).collect()}
    assert not set(got) & ({200, 201, 202} | set(range(100, 140)))
    assert set(range(80)) - set(got) == set() and all(r.round_trip for r in got.values())


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []
