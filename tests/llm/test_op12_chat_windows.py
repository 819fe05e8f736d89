"""Windows against a plain walk over the turns, and texts read back from what is written."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from tessera.llm import op12_chat_windows as cw

SCHEMA = "conv_id long, turn long, role string, text string, window string, segment string, tokens int, piece string, said string"
CONTROL = ["</turn>", "<turn user>", "<\\/turn>", "\\", "<\\\\turn", "<", "</turn>\n<turn assistant>x", "<\\", "\\### Assistant: </turn> ok", "</tur", "é😀<turn"]


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "a", "b", 1, "c", "d") for r in rows], SCHEMA).repartition(parts)


def tokens(text):
    return len(re.findall(r"[^\W_]{1,6}|[^\s\w]|_", text))


def plain(turns, budget, history):
    """Lists of (index, repeated) of each window; turns are (role, tokens)."""
    system = next((i for i, (role, _) in enumerate(turns) if role == "system"), None)
    found, used = [], 0
    for i, (_, n) in enumerate(turns):
        if found and used + n <= budget:
            found[-1].append((i, False))
            used += n
            continue
        top = turns[system][1] if system is not None and system < i else 0
        past, load = [], 0
        for j in range(i - 1, max(i - cw.REACH, 0) - 1, -1):
            own = 0 if j == system else turns[j][1]
            if load + own > min(history, budget - top - n):
                break
            load += own
            past.insert(0, j)
        shown = ([system] if top or (system is not None and system < i) else []) + [j for j in past if j != system]
        found.append([(j, True) for j in shown] + [(i, False)])
        used = top + load + n
    return found


def random_rows(seed, convs=40):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, 14)):
            role = "system" if t == 0 and rng.random() < 0.4 else rng.choice(["user", "assistant", "assistant", "tool", "system"])
            text = " ".join(rng.choice(["word", "longer", "ok", *CONTROL]) for _ in range(rng.choice([0, 3, 20, 60])))
            rows.append((c, t * 2, role, text))
    return rows


def by_conv(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.segment, r.window)):
        found.setdefault(r.conv_id, []).append(r)
    return found


@pytest.mark.parametrize("budget,history", [(60, 25), (10_000, 100), (1, 0), (45, 0)])
def test_windows_as_a_plain_walk(spark, budget, history):
    rows = random_rows(budget)
    got = by_conv(cw.read_back(cw.chat_windows(table(spark, rows), budget=budget, history=history, tokens=F.char_length("text").cast("int"))))
    assert len(got) == 40
    for c, windows in got.items():
        turns = sorted((t, role, text) for k, t, role, text in rows if k == c)
        want = plain([(role, len(text)) for _, role, text in turns], budget, history)
        assert [[(t.turn // 2, t.repeated) for t in w.turns] for w in windows] == want
        for w in windows:
            assert w.n_tokens == sum(len(turns[t.turn // 2][2]) for t in w.turns) and w.over_budget == (w.n_tokens > budget)
            assert [(s.role, s.text, s.repeated) for s in w.said] == [(turns[t.turn // 2][1], turns[t.turn // 2][2], t.repeated) for t in w.turns]
            assert [s.target for s in w.said] == [turns[t.turn // 2][2] if t.role == "assistant" and not t.repeated else None for t in w.turns]
            assert w.formatted.count("</turn>\n") == len(w.turns)


def test_tokens_by_default(spark):
    text = "Internationally known; naïve café_x 12345678 漢字!"
    window = cw.chat_windows(table(spark, [(1, 0, "user", text)])).first()
    assert window.n_tokens == tokens(text)


@pytest.mark.parametrize("text", CONTROL)
def test_escape_is_reversible(spark, text):
    df = spark.createDataFrame([(text + tail,) for tail in ("", "<", "\\", "</turn>", "turn")], "text string")
    df = df.withColumn("out", cw.escaped(F.col("text"))).withColumn("back", cw.unescaped(F.col("out")))
    for r in df.collect():
        assert r.back == r.text and "</turn" not in r.out and "<turn" not in r.out


def test_hot_conversation_in_segments(spark, monkeypatch):
    """One conversation of most rows: each turn is new once, and no layout changes a window."""
    monkeypatch.setattr(cw, "SEGMENT", 16)
    rng = random.Random(4)
    hot = [(5, t, "system" if t == 3 else rng.choice(["user", "assistant"]), "x" * rng.randint(0, 30)) for t in range(200)]
    rows = hot + random_rows(9, 5)
    out = [by_conv(cw.chat_windows(table(spark, rows, parts), budget=90, history=40, tokens=F.char_length("text").cast("int"))) for parts in (1, 7)]
    assert {c: [w.asDict(True) for w in ws] for c, ws in out[0].items()} == {c: [w.asDict(True) for w in ws] for c, ws in out[1].items()}
    windows = out[0][5]
    assert [t.turn for w in windows for t in w.turns if not t.repeated] == list(range(200))
    assert {w.segment for w in windows} == set(range(13))
    for w in windows:
        old = [t.turn for t in w.turns if t.repeated]
        new = [t.turn for t in w.turns if not t.repeated]
        assert w.n_tokens <= 90
        if new[0] > 3:
            assert old[0] == 3 and old[1:] == list(range(new[0] - len(old) + 1, new[0]))
    assert any(len([t for t in w.turns if t.repeated]) > 1 for w in windows if w.window == 0 and w.segment > 0)


def test_odd_rows(spark, monkeypatch):
    long = "word " * 60_000
    rows = [(None, None, None, None), (None, 1, "assistant", None), (1, None, "user", "a"), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (2, 0, "assistant", ""), (3, 0, "user", long), (3, 1, "assistant", "after")]
    for segment in (1024, 1):
        monkeypatch.setattr(cw, "SEGMENT", segment)
        got = by_conv(cw.read_back(cw.chat_windows(table(spark, rows))))
        said = {c: [(s.role, s.text, s.target) for w in ws for s in w.said if not s.repeated] for c, ws in got.items()}
        assert said == {
            None: [("", "", None), ("assistant", "", "")],
            1: [("user", "a", None), ("assistant", "b", "b"), ("assistant", "b", "b")],
            2: [("assistant", "", "")],
            3: [("user", long, None), ("assistant", "after", "after")],
        }
        assert [w.over_budget for w in got[3]] == [True, False]
    empty = cw.chat_windows(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["conv_id", "segment", "window", "n_tokens", "over_budget", "formatted", "turns"] and empty.count() == 0
