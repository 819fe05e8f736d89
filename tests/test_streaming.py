"""Streams over files."""

from __future__ import annotations

from datetime import datetime, timedelta

from tessera.streaming import log

START = datetime(2026, 1, 1)


def run(spark, stream, name, mode, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_sliding_counts(spark, tmp_path):
    rows = [(START + timedelta(minutes=m), "view" if m % 2 else "click") for m in range(0, 120, 10)]
    spark.createDataFrame(rows, "at timestamp, category string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, category string").parquet(str(tmp_path / "in"))
    got = run(spark, log.sliding_counts(stream, "at", "category", length="1 hour", slide="30 minutes"), "counts", "complete", tmp_path)
    assert sum(r.n for r in got) == 2 * len(rows)


def test_first_seen(spark, tmp_path):
    rows = [(START, "a"), (START, "b"), (START + timedelta(hours=1), "a")]
    spark.createDataFrame(rows, "at timestamp, digest string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, digest string").parquet(str(tmp_path / "in"))
    assert sorted(r.digest for r in run(spark, log.first_seen(stream, "at", "digest"), "seen", "append", tmp_path)) == ["a", "b"]


def test_decisions_ignore_order_of_arrival(spark, tmp_path):
    rows = [("q", "late", START + timedelta(hours=2), "accepted"), ("q", "early", START, "accepted"), ("p", "x", START, "dismissed")]
    spark.createDataFrame(rows, "question string, key string, decided_at timestamp, status string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("question string, key string, decided_at timestamp, status string").parquet(str(tmp_path / "in"))
    got = run(spark, log.decisions(stream), "decided", "update", tmp_path)
    assert {(r.question, r.key) for r in got} == {("q", "late"), ("p", "x")}
