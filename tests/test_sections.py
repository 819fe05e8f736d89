"""A log folded in any parts, in a batch or as a stream, gives the same states."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from tessera.operators import sections

BY, SCHEMA = ["document", "section"], "document string, section string, at long, kind string"
KINDS = ["complete", "reopen", "mark_stale", "clear_stale", "edit", "other"]


def log(seed=0, n=300):
    rng = random.Random(seed)
    return [(rng.choice("xy"), rng.choice("abcd"), at, rng.choice(KINDS)) for at in range(n)]


def plain(rows):
    states = {}
    for d, s, _, kind in sorted(rows, key=lambda r: r[2]):
        state = states.setdefault((d, s), [False, False, 0])
        if kind in ("complete", "reopen"):
            state[:2] = [kind == "complete", False]
        elif kind in ("mark_stale", "clear_stale"):
            state[1] = kind == "mark_stale"
        state[2] += kind == "edit"
    return {k: tuple(v) for k, v in states.items()}


def told(kept):
    return {(r.document, r.section): (r.completed, r.stale, r.n_edits) for r in sections.facts(kept, BY).collect()}


def test_any_parts_give_the_same(spark):
    rows = log()
    want = plain(rows)
    assert told(sections.folded(spark.createDataFrame(rows, SCHEMA), BY, "kind", ["at"])) == want
    random.Random(1).shuffle(rows)
    for size in (1, 7, 100):
        kept = None
        for at in range(0, len(rows) if size > 1 else 6, size):
            part = sections.folded(spark.createDataFrame(rows[at : at + size], SCHEMA), BY, "kind", ["at"])
            kept = part if kept is None else sections.merged(kept, part, BY)
        assert told(kept) == (want if size > 1 else plain(rows[:6]))


def test_stream_gives_the_same(spark, tmp_path):
    rows = log(2)
    for n in range(3):
        spark.createDataFrame(rows[n::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = sections.folded(stream, BY, "kind", ["at"])
    query = kept.writeStream.format("memory").queryName("facts").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert told(spark.table("facts")) == plain(rows)


def test_states(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    parts = frame([("d", s) for s in "abcdefg"], "document string, section string")
    needs = frame([("d", "b", "a"), ("d", "c", "b"), ("d", "c", "nowhere"), ("d", "e", "a")], "document string, section string, depends_on string")
    known = frame([("d", "a", True, False), ("d", "d", True, False), ("d", "f", True, True)], "document string, section string, completed boolean, stale boolean")
    content = frame([("d", s) for s in "abdef"], "document string, section string")
    questions = frame([("d", "e", "q1", True), ("d", "e", "q2", True), ("d", "e", "q3", True), ("d", "e", "q4", False), ("d", "b", "q1", True)], "document string, section string, question string, required boolean")
    answers = frame([("d", "e", "q1", " ", "user"), ("d", "e", "q2", "x", "proposed"), ("d", "b", "q1", "x", "user")], "document string, section string, question string, value string, source string")
    missing = sections.missing_answers(questions, answers, BY)
    results = frame([("d", "d", "r1", "blocker", "fail"), ("d", "d", "r2", "warning", "error"), ("d", "b", "r1", "blocker", "pass")], "document string, section string, requirement string, severity string, outcome string")
    got = {r.section: (r.status, r.blocked_by, r.missing, r.failures, r.blockers, r.can_draft, r.can_complete) for r in sections.section_states(parts, needs, known, content, missing, results).collect()}
    assert got == {
        "a": ("complete", [], [], [], [], True, True),
        "b": ("drafted", [], [], [], [], True, True),
        "c": ("blocked", ["b", "nowhere"], [], [], [], False, False),
        "d": ("needs_input", [], [], ["r1", "r2"], ["r1"], True, False),
        "e": ("needs_input", [], ["q1", "q2", "q3"], [], [], False, True),
        "f": ("stale", [], [], [], [], True, True),
        "g": ("empty", [], [], [], [], True, False),
    }


def test_edits_of_complete_sections_are_told(spark):
    rows = [("d", "a", 1, "edit"), ("d", "a", 2, "complete"), ("d", "a", 3, "edit"), ("d", "a", 4, "reopen"), ("d", "a", 5, "edit"), ("d", "b", 1, "complete"), ("d", "b", 2, "mark_stale"), ("d", "b", 3, "edit")]
    below = spark.createDataFrame([("d", "c", "a", 3), ("d", "b", "a", 2)], "document string, source string, target string, position int")
    got = sections.told_of_edits(spark.createDataFrame(rows, SCHEMA), below, BY, "kind", ["at"]).orderBy(F.col("section")).collect()
    assert [(r.section, r.at, r.dependents) for r in got] == [("a", 3, ["b", "c"]), ("b", 3, [])]


def test_progress(spark):
    from tessera.operators import gate

    questions = spark.createDataFrame([("a", q) for q in "wxyz"] + [("b", "x")], "section string, question string")
    answers = spark.createDataFrame([("a", "w", "said", "user"), ("a", "x", "said", "proposed"), ("a", "y", " ", "user"), ("b", "x", "said", None)], "section string, question string, value string, source string")
    got = {r.section: tuple(r)[1:] for r in gate.progress(questions, answers).collect()}
    assert got == {"a": (4, 1, 1, 25, False), "b": (1, 1, 0, 100, True)}
