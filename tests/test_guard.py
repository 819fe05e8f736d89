"""Every way to cut a text into pieces ends at the same place."""

from __future__ import annotations

import random

from tessera.streaming import guard

TEXTS = [
    ('{"a": {"b": "}"}} rest', ("closed", 17)), ('  {"a": "\\"}"} ', ("closed", 14)), ("{" + " " * 80 + "}", ("closed", 82)), ("{" + "\n" * 81 + "}", ("padded", 82)), ("{" + "\t" * 500, ("padded", 82)),
    ('{"a": "' + " " * 200 + '"}', ("closed", 209)), ('{"a": "\\\\"}', ("closed", 11)), ('{"a": [1, 2', ("open", 11)), ("", ("open", 0)), ("}{}", ("open", 3)), ("} {} {", ("open", 6)), ("😀 {}é", ("closed", 4)), ('"{" {"x":1}', ("closed", 11)),
]


def plain(text):
    """By single characters."""
    depth = blanks = 0
    begun = inside = escaped = False
    for n, c in enumerate(text, 1):
        if inside:
            inside = escaped or c != '"'
            escaped = c == "\\" and not escaped
            continue
        blanks = blanks + 1 if c.isspace() else 0
        if blanks > 80:
            return "padded", n
        inside = c == '"'
        begun |= c == "{"
        depth += (c == "{") - (c == "}")
        if c == "}" and begun and depth == 0:
            return "closed", n
    return "open", len(text)


def fed(pieces):
    state = guard.Guard()
    for p in pieces:
        state.feed(p)
    return state.outcome, state.at


def test_known_texts():
    for text, want in TEXTS:
        assert fed([text]) == want == plain(text), text


def test_every_cut_gives_the_same():
    rng = random.Random(3)
    texts = [t for t, _ in TEXTS] + ["".join(rng.choices(['"', "{", "}", "\\", " ", "\n", "x", " " * 30], k=rng.randint(0, 40))) for _ in range(300)]
    for text in texts:
        want = plain(text)
        assert all(fed([text[:i], text[i:]]) == want for i in range(len(text) + 1)), text
        assert fed(list(text)) == want
        cuts = sorted(rng.choices(range(len(text) + 1), k=5))
        assert fed([text[a:b] for a, b in zip([0, *cuts], [*cuts, None], strict=True)]) == want


def rows(rng):
    for call, (text, _) in enumerate(TEXTS):
        cuts = sorted(rng.choices(range(len(text) + 1), k=4))
        yield from ((call, n, text[a:b]) for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, None], strict=True)))


def test_batch(spark):
    pieces = list(rows(random.Random(1)))
    random.Random(2).shuffle(pieces)
    df = spark.createDataFrame([(*p, "x") for p in [*pieces, (99, 0, None)]], "call long, seq long, piece string, outcome string").repartition(3)
    got = {r.call: (r.outcome, r.at) for r in guard.guarded(df).collect()}
    assert got == {c: want for c, (_, want) in enumerate(TEXTS)} | {99: ("open", 0)}
    assert guard.guarded(df.limit(0)).collect() == []


def test_stream_in_any_order(spark, tmp_path):
    """Pieces come over several batches, out of order and twice."""
    pieces = list(rows(random.Random(5)))
    pieces += pieces[::3]
    random.Random(6).shuffle(pieces)
    for n in range(4):
        spark.createDataFrame(pieces[n::4], "call long, seq long, piece string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("call long, seq long, piece string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = guard.guarded_stream(stream).writeStream.format("memory").queryName("guarded").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = sorted(tuple(r) for r in spark.table("guarded").collect())
    assert got == sorted((c, *want) for c, (_, want) in enumerate(TEXTS) if want[0] != "open")
