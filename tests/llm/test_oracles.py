"""Queries of this subpackage against their SQL, and retrieval against brute force."""

from __future__ import annotations

import os

import pytest
from tessera.llm import op7_decontamination as dc
from tessera.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TESSERA_TEST_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df = QUERIES[name](spark, FOLDER)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_recall_of_benchmark_search(spark, folder="/root/testdata/sf0.01"):
    """At least nine tenths of what a search of every window with every item confirms; nothing else."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, folder).select("doc_id", "item_id").collect()}
    words = lambda t: dc.normal((t or "").encode()).decode().split()
    numbers: dict[str, int] = {}
    ids = lambda ws: [numbers.setdefault(w, len(numbers)) for w in ws]
    wanted = {(i.item_id): ids(words(i.text)) for i in items}
    known = set(numbers.values())
    brute = set()
    for d in docs:
        text = ids(words(d.text))
        for k, item in wanted.items():
            n = len(item)
            for at in range(0, max(1, len(text)), max(1, n // 2)):
                part = text[at : at + 2 * n]
                if len(set(part) & set(item) & known) < dc.WITH_ANSWER * len(set(item)):
                    continue
                share = dc.subsequence(item, part) / n
                if share >= dc.SUBSEQUENCE or (share >= dc.WITH_ANSWER and dc.subsequence(item[-dc.ANSWER_WORDS :], part) == dc.ANSWER_WORDS):
                    brute.add((d.doc_id, k))
                    break
    assert len(brute) >= 5
    assert len(got & brute) >= 0.9 * len(brute)
    assert len(got - brute) <= 0.1 * len(brute)
