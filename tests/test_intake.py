"""Digests of pastes, claims, filed passages and edits, with rows that repeat."""

from __future__ import annotations

import random
import re

import pytest
from tessera.operators import history, intake


def test_filed_here_keeps_repeated_passages(spark):
    passages = spark.createDataFrame([("s", "The shaft is worn down badly here."), ("s", "The shaft is worn down badly here."), ("s", "Nothing."), ("t", "The shaft is worn down")], "section string, text string")
    answers = spark.createDataFrame([("s", "q2", "shaft is worn"), ("s", "q1", "shaft"), ("s", "q3", ""), ("s", "q4", None), ("t", "q5", "down")], "section string, question string, quote string")
    got = sorted((r.section, r.text, r.questions) for r in intake.filed_here(passages, answers, ["section"]).collect())
    assert got == [("s", "Nothing.", []), ("s", "The shaft is worn down badly here.", ["q1", "q2"]), ("s", "The shaft is worn down badly here.", ["q1", "q2"]), ("t", "The shaft is worn down", ["q5"])]


def test_claims_go_to_the_newest_paste(spark):
    pastes = spark.createDataFrame([("c", 1, 10, "one two three four"), ("c", 2, 20, "one  TWO three four five"), ("c", 3, 30, "other"), ("d", 4, 40, "one two three")], "case string, paste_id long, pasted_at long, text string")
    answers = spark.createDataFrame([("c", "a", "two three four"), ("c", "a", "two three four"), ("c", "b", "ne tw"), ("c", "x", "missing words here"), ("c", "y", ""), ("d", "a", "one")], "case string, question string, quote string")
    got = sorted((r.case, r.question, r.quote, r.paste_id) for r in intake.claims(answers, pastes, "case").collect())
    assert got == [("c", "a", "two three four", 2), ("c", "a", "two three four", 2), ("c", "b", "ne tw", 2), ("d", "a", "one", 4)]


def test_digest_by_section(spark):
    links = spark.createDataFrame([(1, 7, "s2", "b  b", 5), (2, 7, "s2", "a a", 4), (3, 7, "zz", "nowhere", 6), (4, 8, "s1", "a", 1)], "link_id long, paste_id long, section string, quote string, created_at long")
    claimed = spark.createDataFrame([(7, "s1", "q9", 2, "user"), (7, "s1", "q8", 1, "proposed"), (7, "s2", "q1", 1, "user")], "paste_id long, section string, question string, question_no long, source string")
    sections = spark.createDataFrame([("s1", 1), ("s2", 2)], "section string, section_no int")
    got = sorted((r.paste_id, r.section_no, r.section, r.links, r.questions, r.confirmed) for r in intake.sections_filed(links, claimed, sections).collect())
    assert got == [(7, 1, "s1", [], ["q8", "q9"], 1), (7, 2, "s2", [2, 1], ["q1"], 1), (7, 100, "zz", [3], [], 0), (8, 1, "s1", [4], [], 0)]
    pastes = spark.createDataFrame([(7, "x A\n> a B b"), (8, "no")], "paste_id long, text string")
    spans = sorted(tuple(r) for r in intake.link_spans(links, pastes, sections).collect())
    assert spans == [(7, 2, 2, 7), (7, 2, 8, 11)]


@pytest.mark.parametrize("width", [1024, 8, 1])
def test_united_as_brute_force(spark, width):
    """Overlapping, touching, nested, empty and repeated spans; one text has most of them."""
    rng = random.Random(width)
    rows = []
    for _ in range(600):
        a = rng.randint(0, 300)
        rows.append((rng.choice([1, 1, 1, 2, None]), a, a + rng.choice([0, 1, 2, 5, 40, -1])))
    rows += rows[:50] + [(1, None, 5), (3, 0, 100_000), (3, 50, 60), (3, 100_000, 100_001)]
    df = spark.createDataFrame(rows, "t long, char_from long, char_to long").repartition(3)
    want = []
    for t in {r[0] for r in rows}:
        held = None
        for a, b in sorted((a, b) for k, a, b in rows if k == t and a is not None and b > a):
            if held and a <= held[1]:
                held[1] = max(held[1], b)
            else:
                held = [a, b]
                want.append((t, held))
    want = sorted(((t, a, b) for t, (a, b) in want), key=repr)
    assert sorted((tuple(r) for r in intake.united(df, ["t"], width=width).collect()), key=repr) == want


def test_two_edits_of_one_draft(spark):
    drafts = spark.createDataFrame([(1, "old", 3), (2, "old", 1), (3, "old", 0)], "id int, body string, token int")
    edits = spark.createDataFrame([(1, "b", 3), (1, "a", 3), (1, "c", 2), (2, "x", 7), (1, "a", 3)], "id int, body string, token int")
    got = sorted(tuple(r) for r in history.edited(drafts, edits, ["id"], ["body"]).collect())
    assert got == [(1, "a", 4, "changed"), (2, "old", 1, "conflict"), (3, "old", 0, "kept")]
    lost = sorted(tuple(r) for r in history.conflicts(drafts, edits, ["id"], ["body"]).collect())
    assert lost == [(1, "a", 3), (1, "b", 3), (1, "c", 2), (2, "x", 7)]


@pytest.mark.parametrize("times", [1, 10])
def test_united_tasks_hold_no_more_rows_than_allowed(spark, monkeypatch, times):
    """Ten times the texts take ten times the tasks, in either sweep; the stretches are the same."""
    monkeypatch.setattr(intake, "ROWS_A_TASK", 100)
    rows = [(t, b, b + 3) for t in range(20 * times) for b in range(0, 80, 8)]
    found = intake.united(spark.createDataFrame(rows + [(0, 5, 5), (None, 1, 2)], "t int, char_from int, char_to int"), ["t"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    tasks = -(-(len(rows) + 1) // 100)
    assert [int(n.split(")")[0].split(",")[0]) for n in re.findall(r"RepartitionByExpression .*?\], (\d+)", plan)] == [tasks, tasks]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([*rows, (None, 1, 2)], key=repr)
