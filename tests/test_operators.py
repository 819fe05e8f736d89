"""Operators whose queries do not show every case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tessera.operators import checks, extraction, gate, graph, history, intake, lexical, patterns, render, sources, specs


def test_patterns_are_refused():
    for bad in ("", "  ", "(", "a*"):
        with pytest.raises(patterns.PatternError):
            patterns.compiled(bad)
    assert patterns.unmatched(r"NW-\d+", ["NW-12", "x NW-12", ""]) == ["x NW-12"]


def test_slow_patterns_give_an_error(spark):
    rows = spark.createDataFrame([(1, "a" * 6000 + "b"), (2, "xaaa"), (3, None)], "id int, t string")
    got = patterns.hits(rows, "id", "t", r"(a+)+$", timeout=0.2).collect()
    assert {(r.id, r.value, r.error) for r in got} == {(1, None, "too slow"), (2, "aaa", None)}


def test_groups_offsets_and_quotes(spark):
    rows = spark.createDataFrame([(1, "😀 Charge: L-1, Charge: L-2")], "id int, t string")
    got = patterns.with_quotes(patterns.hits(rows, "id", "t", r"Charge:\s*(\S+?)(?:,|$)"), rows, "id", "t").orderBy("pos").collect()
    assert [(r.value, r.char_from, r.char_to) for r in got] == [("L-1", 10, 13), ("L-2", 23, 26)]
    native = patterns.native_hits(rows, "t", r"L-\d").orderBy("pos").collect()
    assert [(r.value, r.char_from, r.char_to) for r in native] == [("L-1", 10, 13), ("L-2", 23, 26)]


def test_keyword_phrases_and_stems(spark):
    rows = spark.createDataFrame([(1, "de", "Die Toleranzen sind eng"), (2, "de", "Die Toleranz der Welle, zu enge Welle"), (3, "en", "Toleranzen")], "id int, lang string, t string")
    terms = spark.createDataFrame([("de", "Toleranz"), ("de", "enge Welle")], "lang string, term string")
    got = {r.id: (r.terms, r.hits) for r in lexical.keyword_hits(rows, terms, "id", "t").collect()}
    assert got == {1: (["Toleranz", "enge Welle"], 2), 2: (["Toleranz", "enge Welle"], 3)}


def test_ranks_fall_back(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "id int, t string")
    asked = spark.createDataFrame([("q1", "alpha"), ("q2", "zeta")], "query string, query_text string")
    best = lexical.bm25(rows, asked, "id", "t").withColumn("arbitrary", F.lit(False))
    first = lexical.in_order(rows, "id", 1).select(F.lit("q2").alias("query"), "id", "score", "rank", "arbitrary")
    assert {(r.query, r.id, r.arbitrary) for r in lexical.best_of([best, first], "query").collect()} == {("q1", 1, False), ("q2", 1, True)}


def test_candidates_pick_tier_then_score_then_order(spark):
    rows = [("q", "k", 1, 5.0, "s1", "p1", 3, "v3", "x"), ("q", "k", 0, 1.0, "s2", "p2", 2, "v2", "y"), ("q", "k", 0, 1.0, "s2", "p2", 1, "v1", "y"), ("q", "", 0, 1.0, "s", "p", 0, "no", "z")]
    df = spark.createDataFrame(rows, "question string, key string, tier int, score double, source string, where string, ord int, value string, quote string")
    got = extraction.candidates(df).collect()
    assert len(got) == 1 and (got[0].value, got[0].tier, got[0].score, got[0].hits, got[0].places, len(got[0].occurrences)) == ("v1", 0, 2.0, 3, 2, 2)
    assert extraction.n_merged(extraction.candidates(df)).first().merged == 2


def test_funnel_reconciles(spark):
    rows = spark.createDataFrame([("q", o) for o in extraction.OUTCOMES for _ in range(2)], "question string, outcome string")
    r = extraction.funnel(rows, ["question"]).first()
    assert r.asked == r.found + r.not_stated + r.quote_rejected + r.type_rejected + r.error == 10


def test_question_sets_load_behind(spark):
    old = spark.createDataFrame([("c", "a", 1), ("c", "b", 2)], "case string, key string, seq long")
    new = spark.createDataFrame([("c", "b", 1), ("c", "x", 2), ("c", "y", 3)], "case string, key string, seq long")
    assert {(r.key, r.seq) for r in extraction.loaded(old, new, "case", "key", "seq").collect()} == {("a", 1), ("b", 2), ("x", 3), ("y", 4)}


def test_checks(spark):
    df = spark.createDataFrame([(["a", ""], {"x": "1", "y": " "}, [{"x": "1"}, {"x": " ", "y": "2"}])], "items array<string>, fields map<string,string>, rows array<map<string,string>>")
    wanted = F.array(F.lit("x"), F.lit("y"))
    r = df.select(checks.fields_filled(F.col("rows"), wanted, F.lit("s.b")).alias("r")).first().r
    assert (r.outcome, r.evidence) == ("fail", ["s.b[0].y", "s.b[1].x"])
    r = df.select(checks.present(F.lit(False), F.lit("keyvalue"), F.col("fields"), wanted).alias("r")).first().r
    assert (r.outcome, r.reason) == ("fail", "missing: y")
    assert df.select(checks.row_count(F.lit("prose"), F.lit(1), F.lit(1), F.lit(2)).alias("r")).first().r.outcome == "not_applicable"
    words = spark.createDataFrame([("FAIL", True), ("odd", True), ("pass", False)], "w string, up boolean")
    assert [x[0] for x in words.select(checks.verdict(F.col("w"), F.col("up"))).collect()] == ["fail", "fail", "error"]


def test_mentions_need_quotes(spark):
    points = spark.createDataFrame([("d", "p1"), ("d", "p2")], "doc string, point string")
    answers = spark.createDataFrame([("d", "p1", True, "was blocked", "the lot was  blocked"), ("d", "p2", True, "invented", "the lot")], "doc string, point string, established boolean, quote string, text string")
    r = checks.mentions(points, answers, ["doc"], "point", "quote", "text").first()
    assert (r.outcome, r.missing) == ("fail", ["p2"])


def test_gate_uses_the_latest_judgement(spark):
    live = spark.createDataFrame([("d", "r1", "warning", "fail")], "document string, requirement string, severity string, outcome string")
    judged = spark.createDataFrame([("d", "j1", "blocker"), ("d", "j2", "blocker")], "document string, requirement string, severity string")
    stored = spark.createDataFrame([("d", "j1", 1, "fail"), ("d", "j1", 2, "pass")], "document string, requirement string, assessed_at int, outcome string")
    r = gate.gate_report(live, judged, stored).first()
    assert (r.blockers, r.warnings, r.passes, r.not_evaluated, r.passed) == (0, 1, 1, 1, False)
    allowed = spark.createDataFrame([(False, " "), (False, "agreed"), (True, None)], "p boolean, r string").select(gate.export_allowed(F.col("p"), F.col("r"))).collect()
    assert [x[0] for x in allowed] == [False, True, True]


def test_history(spark):
    rows = spark.createDataFrame([(i, i // 2) for i in range(10)], "id long, at long")
    assert {r.id for r in history.kept_newest(rows, "at", 3).collect()} == {6, 7, 8, 9}
    assert history.kept_newest(rows, "at", 0).count() == 0 and history.kept_newest(rows, "at", 50).count() == 10
    before, after = spark.createDataFrame([("a",), ("b",)], "t string"), spark.createDataFrame([("b",), ("c",)], "t string")
    assert {(r.t, r.change) for r in history.snapshot_diff(before, after, "t").collect()} == {("c", "created"), ("a", "dropped")}


def test_trees_and_loops(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 99), (6, None)], "id long, parent long")
    got = [r.id for r in history.tree_order(nodes, "id", "parent", "id").orderBy("place").collect()]
    assert got == [1, 2, 4, 3, 6, 5]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "s string, t string")
    assert {r.node for r in graph.cyclic(edges, "s", "t").collect()} == {"a", "b", "c"}
    assert graph.reachable(edges.limit(0), "s", "t").count() == 0
    long = spark.range(160).selectExpr("id as s", "id + 1 as t")
    assert graph.reachable(long, "s", "t").count() == 160 * 161 // 2
    deep = spark.range(100).selectExpr("id", "if(id = 0, null, id - 1) as parent").unionByName(spark.createDataFrame([(500, 501), (501, 500), (502, 501)], "id long, parent long"))
    got = history.tree_order(deep, "id", "parent", "id").orderBy("place").collect()
    assert [(r.id, r.depth) for r in got] == [(i, i) for i in range(100)] + [(500, None), (501, None), (502, None)]


def test_intake(spark):
    rows = [(1, 0, 0, "s1", "was blocked", "the lot was blocked", 0.5), (1, 1, 0, "s1", "Was  blocked", "the lot was blocked", 0.9), (1, 1, 1, "gone", "lot", "the lot", 0.9), (1, 1, 2, "nowhere", "lot", "the lot", 0.9), (1, 1, 3, "s1", "invented", "the lot", 0.9)]
    df = spark.createDataFrame(rows, "paste int, part_no int, ord int, section string, quote string, text string, confidence double")
    got = intake.checked(df, spark.createDataFrame([("s1",)], "section string"))
    assert sorted(r.state for r in got.collect()) == ["discarded", "discarded", "placed", "placed", "unplaced"]
    assert [r.part_no for r in intake.merged(got.where("state = 'placed'"), ["paste", "section"]).collect()] == [0]
    spans = intake.quote_spans(spark.createDataFrame([(1, "a\n> lot  was", "lot was"), (2, "x", "y"), (3, None, None)], "id int, t string, q string"), "id", "t", "q")
    assert {r.id: (r.char_from, r.char_to) for r in spans.collect()} == {1: (4, 12), 2: (None, None), 3: (None, None)}
    answers = spark.createDataFrame([("c", "k1", "the lot was blocked"), ("c", "k2", "no such quote")], "case string, key string, quote string")
    pastes = spark.createDataFrame([("c", 1, 1, "the lot was blocked"), ("c", 2, 2, "again: the lot was  blocked."), ("d", 3, 3, "the lot was blocked")], "case string, paste_id int, pasted_at int, text string")
    assert [(r.key, r.paste_id) for r in intake.claims(answers, pastes, "case").collect()] == [("k1", 2)]


def test_sources_and_images(spark):
    rows = spark.createDataFrame([(1, "c", "x"), (2, "c", "x"), (3, "c", "y"), (4, "d", "x")], "id int, case string, body string")
    got = {r.id: r.status for r in sources.with_repeats(rows, ["case"], "body", [F.col("id")]).collect()}
    assert got == {1: "queued", 2: "repeat", 3: "queued", 4: "queued"}
    left = sources.without(rows, rows.where("id = 1").select("id"), "id", ["case"], "body", [F.col("id")])
    assert {r.id: r.status for r in left.collect()} == {2: "queued", 3: "queued", 4: "queued"}
    images = spark.createDataFrame([("c", 1, "h1", 100, 100), ("c", 2, "h1", 100, 100), ("c", 3, "h2", 60, 500), ("c", 4, "h3", 2000, 90), ("c", 5, "h4", None, None)], "case string, image_id int, sha256 string, width int, height int")
    r = sources.image_report(images).first()
    assert (r.kept, r.repeated, r.too_small, r.unreadable) == (1, 1, 2, 1)


def test_render(spark):
    df = spark.createDataFrame([([{"a": "x|y", "b": "true"}, {"a": None}],)], "rows array<map<string,string>>")
    text = df.select(render.markdown_table(F.array(F.lit("a"), F.lit("b")), F.col("rows"))).first()[0]
    assert text == "| a | b |\n| --- | --- |\n| x\\|y | yes |\n| — | — |"
    blocks = spark.createDataFrame([("d", 1, "Intro", 1, "Intro", "text"), ("d", 2, "Facts", 1, "One", "a"), ("d", 2, "Facts", 2, "Two", ""), ("d", 3, "Empty", 1, "x", "")], "document string, section_no int, title string, block_no int, name string, body string")
    assert render.markdown(blocks).first().markdown == "## Intro\n\ntext\n\n## Facts\n\n### One\n\na"
    assert '"title":"Intro"' in render.as_json(blocks).first().json
    templates = spark.createDataFrame([(1, "{{ intro.text }} {{gone.x}}")], "id int, t string")
    declared = spark.createDataFrame([("intro.text",), ("facts.rows",)], "tag string")
    assert {(r.problem, r.tag) for r in render.template_problems(templates, declared, "id", "t").collect()} == {("unknown", "gone.x"), ("missing", "facts.rows")}


def test_spec_words(spark):
    df = spark.createDataFrame([("length", "s.text", {"min": "5"}), ("cross_ref", "s.rows", {"field": "id", "target": "a.b.c"})], "kind string, place string, params map<string,string>")
    got = [r[0] for r in df.select(specs.sentence(F.col("kind"), F.col("place"), F.col("params"))).collect()]
    assert got == ["s.text must have at least 5 words", "id in s.rows must occur in a.b.c"]
    paths = spark.createDataFrame([("a",), ("a.b",), ("ab.c",)], "p string").select(specs.renamed_path(F.col("p"), "a", "z")).collect()
    assert [x[0] for x in paths] == ["z", "z.b", "ab.c"]


def test_lint_of_references(spark):
    frame = spark.createDataFrame
    long = "x" * 101
    sections = frame([("s", "a")], "spec string, section string")
    columns = frame([("s", "a", "b", "c", 0), ("s", "a", "b", "c", 1), ("s", "a", "b", "c", 2), ("s", "a", "b", long, 3)], "spec string, section string, block string, column string, position int")
    questions = frame([("s", "a", "q", 0), ("s", "a", "q", 1), ("s", "a", "p", 2)], "spec string, section string, question string, position int")
    needs = frame([("s", "r1", "a", "b", "c", "a.b.c", 0), ("s", "r1", "a", "b", "d", "a.b.d", 1), ("s", "r2", "a", "b", None, None, 2)], "spec string, id string, section string, block string, field string, references string, position int")
    criteria = frame([("s", "r2", "rubric", 0), ("s", "k", "present", 1)], "spec string, id string, kind string, position int")
    scopes = frame([("s", "k", "a"), ("s", "k", "z")], "spec string, id string, section string")
    from tessera.operators import specs

    got = sorted((r.rule, r.subject) for r in specs.lint_references(sections, columns, questions, needs, criteria, scopes).collect())
    assert got == sorted([
        ("column twice", "a.b.c"), ("question twice", "a.q"), ("id twice", "r1"), ("id twice", "r2"), ("unknown field", "r1: d"), ("unknown reference", "r1: a.b.d"),
        ("unknown scope", "k: z"), ("a rule and no criterion", "k"), ("key too long", "x" * 40),
    ])


def test_reachable_meets_each_pair_of_a_chain_once(spark, monkeypatch):
    written = []

    def counted(df):
        df = checkpointed(df)
        written.append(df.count())
        return df

    checkpointed = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", counted)
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "s int, t int")
    assert graph.reachable(chain, "s", "t").count() == 64 * 65 // 2
    assert sum(written) <= 64 * 65


def test_repeated_keys_are_counted_and_not_sorted(spark):
    from tessera.plans.registry import QUERIES

    plan = QUERIES["lint_orders"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
