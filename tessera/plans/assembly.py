"""Queries that put documents, types and checks together from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators import checks as C
from tessera.operators import gate as G
from tessera.operators import history as H
from tessera.operators import intake as I
from tessera.operators import render as R
from tessera.operators import specs as S
from tessera.operators import split as P
from tessera.plans.query import query
from tessera.session import table


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS section_no FROM orders),
e AS (SELECT o_custkey, o_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'question' ELSE 'criterion' END AS kind, section_no FROM s JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, l_linenumber, 'S' || section_no || '-' || CASE kind WHEN 'question' THEN 'Q' ELSE 'C' END || row_number() OVER (PARTITION BY o_custkey, section_no, kind ORDER BY l_linenumber) AS ref FROM e
""")
def element_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer as sections, their lines as questions and criteria."""
    orders = S.walk(table(spark, folder, "orders"), ["o_custkey"], [F.col("o_orderkey")], "o_orderkey").select("o_custkey", "o_orderkey", F.col("step_no").alias("section_no"))
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "question").otherwise("criterion")
    return S.refs(orders.join(lines, "o_orderkey").withColumn("kind", kind), ["o_custkey"], "section_no", "kind", [F.col("l_linenumber")]).select("o_orderkey", "l_linenumber", "ref")


@query("""
SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS step_no, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def walked_steps(spark: SparkSession, folder: str) -> DataFrame:
    found = S.walk(table(spark, folder, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey")
    return found.select("o_orderkey", "step_no", "before", "after")


@query("""
SELECT doc_id, concat_ws(' · ', source, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'p. ' || (doc_id % 50) ELSE 'pp. ' || (doc_id % 50) || '–' || (doc_id % 50 + 2) END,
  CASE WHEN doc_id % 2 = 0 THEN lang || ' › ' || 'Part' END) AS label FROM documents
""")
def passage_labels(spark: SparkSession, folder: str) -> DataFrame:
    page = F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 50).cast("int"))
    last = F.when(F.col("doc_id") % 3 == 2, page + 2).otherwise(page)
    path = F.when(F.col("doc_id") % 2 == 0, F.array("lang", F.lit("Part"))).otherwise(F.array().cast("array<string>"))
    return table(spark, folder, "documents").select("doc_id", P.where_label(F.col("source"), page, last, path).alias("label"))


@query(r"""
WITH a AS (SELECT conv_id, turn AS question, left(text, 40) AS quote FROM conversations WHERE turn % 2 = 0),
n AS (SELECT *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS s FROM conversations), q AS (SELECT *, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS k FROM a)
SELECT n.conv_id, n.turn, list_sort(coalesce(list(DISTINCT q.question) FILTER (k <> '' AND (contains(s, replace(k, 'ß', 'ss')) OR (len(string_split(k, ' ')) > 8 AND contains(s, array_to_string(string_split(k, ' ')[1:8], ' '))))), [])) AS questions
FROM (SELECT conv_id, turn, replace(s, 'ß', 'ss') AS s FROM n) n LEFT JOIN q ON q.conv_id = n.conv_id GROUP BY n.conv_id, n.turn
""")
def filed_here(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a conversation as a section's passages, with the even turns whose beginnings they hold."""
    talk = table(spark, folder, "conversations")
    answers = talk.where("turn % 2 = 0").select("conv_id", F.col("turn").alias("question"), F.substring("text", 1, 40).alias("quote"))
    return I.filed_here(talk.select("conv_id", "turn", "text"), answers, ["conv_id"]).select("conv_id", "turn", "questions")


@query(r"""
WITH l AS (SELECT o_custkey, 1 AS place, 'overview' AS part, o_orderkey AS position, o_orderpriority AS line FROM orders
  UNION ALL SELECT o_custkey, 2, 'targets', o_orderkey, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END FROM orders
  UNION ALL SELECT c_custkey, 5, 'upstream', 0, c_mktsegment FROM customer),
p AS (SELECT o_custkey, place, part || ':' || chr(10) || string_agg(line, chr(10) ORDER BY position, line) AS t FROM l WHERE trim(line) <> '' GROUP BY o_custkey, place, part)
SELECT o_custkey, string_agg(t, chr(10) || chr(10) ORDER BY place) AS context FROM p GROUP BY o_custkey
""")
def writing_context(spark: SparkSession, folder: str) -> DataFrame:
    """A customer's orders as what a writer is told of a section."""
    orders = table(spark, folder, "orders")
    line = lambda part, text: orders.select("o_custkey", F.lit(part).alias("part"), F.col("o_orderkey").alias("position"), text.alias("line"))
    lines = line("overview", F.col("o_orderpriority")).unionByName(line("targets", F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")))).unionByName(line("unknown", F.lit("left out")))
    above = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit("upstream").alias("part"), F.lit(0).cast("long").alias("position"), F.col("c_mktsegment").alias("line"))
    return R.writing_context(lines.unionByName(above), ["o_custkey"])


@query(r"""
WITH d AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM documents),
t AS (SELECT o_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS blank FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT 'd' || doc_id AS block, 'length' AS kind, CASE WHEN w < 60 OR w > 300 THEN 'fail' ELSE 'pass' END AS outcome,
  concat_ws('; ', CASE WHEN w < 60 THEN w || ' words, at least 60' END, CASE WHEN w > 300 THEN w || ' words, at most 300' END) AS reason, 0 AS n_evidence FROM d
UNION ALL SELECT 'd' || doc_id, 'present', CASE WHEN trim(text) = '' THEN 'fail' ELSE 'pass' END, CASE WHEN trim(text) = '' THEN 'is empty' ELSE '' END, 0 FROM d WHERE doc_id % 2 = 0
UNION ALL SELECT 'd' || doc_id, 'tone', 'error', 'no rule for tone', 0 FROM d WHERE doc_id % 7 = 0
UNION ALL SELECT 'o' || o_orderkey, 'rows', CASE WHEN n < 2 OR n > 5 THEN 'fail' ELSE 'pass' END, CASE WHEN n < 2 THEN n || ' rows, at least 2' WHEN n > 5 THEN n || ' rows, at most 5' ELSE '' END, 0 FROM t
UNION ALL SELECT 'o' || o_orderkey, 'fields_filled', CASE WHEN blank > 0 THEN 'fail' ELSE 'pass' END, CASE WHEN blank > 0 THEN blank || ' cells are empty' ELSE '' END, blank FROM t
UNION ALL SELECT 'o' || o_orderkey, 'format', CASE WHEN n > blank THEN 'fail' ELSE 'pass' END, CASE WHEN n > blank THEN (n - blank) || ' cells are no number' ELSE '' END, n - blank FROM t
""")
def evaluated(spark: SparkSession, folder: str) -> DataFrame:
    """All kinds of rules over documents as prose and orders as tables, in one run."""
    docs, orders = table(spark, folder, "documents"), table(spark, folder, "orders")
    cell = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.create_map(F.lit("line"), F.col("l_linenumber").cast("string"), F.lit("flag"), cell)).alias("rows"))
    none = {"items": "array<string>", "fields": "map<string,string>"}
    empty = lambda df: df.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    prose = empty(docs.select(F.concat(F.lit("d"), "doc_id").alias("block"), F.lit("prose").alias("block_kind"), F.col("text").alias("prose"), F.lit(None).cast("array<map<string,string>>").alias("rows")))
    tables = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    tables = empty(tables.select(F.concat(F.lit("o"), "o_orderkey").alias("block"), F.lit("table").alias("block_kind"), F.lit(None).cast("string").alias("prose"), "rows"))
    contents = prose.unionByName(tables)
    number = F.substring("block", 2, 20).cast("long")
    rule = lambda kind, **params: F.struct(F.lit(kind).alias("kind"), F.create_map(*[F.lit(x) for kv in params.items() for x in kv]).cast("map<string,string>").alias("params"))
    asked_of = lambda df, *rules: df.select("block", F.explode(F.array_compact(F.array(*rules))).alias("rule")).select("block", "rule.*")
    asked = asked_of(prose, rule("length", min_words="60", max_words="300"), F.when(number % 2 == 0, rule("present")), F.when(number % 7 == 0, rule("tone"))).unionByName(
        asked_of(tables, rule("rows", min="2", max="5"), rule("fields_filled", fields="line,flag"), rule("format", field="flag", **{"as": "number"}))
    )
    return C.evaluate(asked, contents, ["block"]).select("block", "kind", "outcome", "reason", F.size("evidence").alias("n_evidence"))


@query(r"""
WITH c AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1),
s AS (SELECT c.conv_id, 'whole' AS criterion, t.turn, t.text FROM c LEFT JOIN conversations t USING (conv_id)
  UNION ALL SELECT c.conv_id, 'ends', t.turn, t.text FROM c LEFT JOIN conversations t ON t.conv_id = c.conv_id AND t.turn IN (0, c.last)
  UNION ALL SELECT c.conv_id, 'nothing', NULL, NULL FROM c)
SELECT conv_id, criterion, coalesce(string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (trim(text) <> ''), '') AS text,
  CASE WHEN count(*) FILTER (trim(text) <> '') = 0 THEN 'fail' END AS outcome FROM s GROUP BY conv_id, criterion
""")
def criterion_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as documents with three criteria: of the whole, of the first and last turn, of no turn that is there."""
    talk = table(spark, folder, "conversations")
    ends = talk.groupBy("conv_id").agg(F.max("turn").alias("last"))
    named = lambda name, scope: ends.select("conv_id", F.lit(name).alias("criterion"), scope.alias("scope"))
    turn = F.col("last").cast("string")
    nothing = F.lit(None).cast("array<string>")
    criteria = named("whole", nothing).unionByName(named("ends", F.array(F.lit("0"), turn, turn))).unionByName(named("nothing", F.array().cast("array<string>")))
    contents = talk.select("conv_id", F.col("turn").cast("string").alias("section"), F.col("turn").alias("position"), "text")
    return C.scoped(criteria, contents, "conv_id").select("conv_id", "criterion", "text", "outcome")


@query("""
WITH a AS (SELECT doc_id % 5 AS document, 'r' || doc_id AS requirement, 'judge' AS species, CASE quality WHEN 1 THEN 'pass' ELSE 'fail' END AS outcome, 1 AS run, 10 AS assessed_at FROM labels),
b AS (SELECT doc_id % 5, 'r' || doc_id, 'rule', CASE toxic WHEN 1 THEN 'fail' ELSE 'pass' END, 2, 20 FROM labels WHERE doc_id % 3 = 0)
SELECT CAST(document AS BIGINT) AS document, requirement, species, outcome, run, assessed_at FROM a UNION ALL SELECT * FROM b
""")
def assessments_stored(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    about = labels.select((F.col("doc_id") % 5).cast("long").alias("document"), F.concat(F.lit("r"), "doc_id").alias("requirement"), "quality", "toxic", "doc_id")
    first = about.select("document", "requirement", F.lit("judge").alias("species"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("outcome"))
    again = about.where("doc_id % 3 = 0").select("document", "requirement", F.lit("rule").alias("species"), F.when(F.col("toxic") == 1, "fail").otherwise("pass").alias("outcome"))
    stored = first.limit(0).withColumns({"run": F.lit(0), "assessed_at": F.lit(0)})
    stored = G.assessed(stored, first, F.lit(1), F.lit(10))
    return G.assessed(stored, again, F.lit(2), F.lit(20))


@query("""
WITH o AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'column' ELSE 'question' END AS level, CASE p_partkey % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'prose' WHEN 2 THEN 'enum' WHEN 3 THEN 'odd' ELSE 'text' END AS kind,
  CASE p_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['a'] WHEN 2 THEN ['a', 'b'] ELSE ['a', 'a'] END AS options, p_size % 2 AS columns FROM part)
SELECT id, 'unknown kind of block' AS problem FROM o WHERE level = 'block' AND kind NOT IN ('prose', 'list', 'keyvalue', 'table')
UNION ALL SELECT id, 'unknown kind of column' FROM o WHERE level = 'column' AND kind NOT IN ('text', 'number', 'date', 'enum', 'boolean')
UNION ALL SELECT id, 'no columns' FROM o WHERE level = 'block' AND kind IN ('table', 'keyvalue') AND columns < 1
UNION ALL SELECT id, 'columns that it cannot have' FROM o WHERE level = 'block' AND kind IN ('prose', 'list') AND columns > 0
UNION ALL SELECT id, 'fewer than two options' FROM o WHERE kind IN ('enum', 'choice') AND len(options) < 2
UNION ALL SELECT id, 'options that it cannot have' FROM o WHERE kind NOT IN ('enum', 'choice') AND len(options) > 0
UNION ALL SELECT id, 'an option twice' FROM o WHERE len(list_distinct(options)) < len(options)
""")
def object_problems(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    pick = lambda n, names: F.element_at(F.array(*names), (F.col("p_partkey") % n + 1).cast("int"))
    words = lambda *w: [F.lit(x) for x in w]
    options = pick(4, [F.array(*words(*o)).cast("array<string>") for o in ((), ("a",), ("a", "b"), ("a", "a"))])
    objects = part.select(F.col("p_partkey").alias("id"), pick(3, words("block", "column", "question")).alias("level"), pick(5, words("table", "prose", "enum", "odd", "text")).alias("kind"), options.alias("options"), (F.col("p_size") % 2).alias("columns"))
    return S.object_problems(objects, ["id"])


@query("""
SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS required, CASE o_orderstatus WHEN 'F' THEN ['present', 'length'] WHEN 'O' THEN ['present', 'rows', 'fields_filled', 'format', 'cross_ref'] ELSE [] END AS offered,
  CASE WHEN o_orderkey % 3 = 0 THEN 'section' WHEN o_orderkey % 3 = 1 THEN 'block' ELSE 'column' END AS form FROM orders
""")
def required_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as blocks: required where a line is returned, with the rules of their kind and the form of a problem at them."""
    orders = table(spark, folder, "orders").withColumn("required", F.lit(False))
    rules = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "present").otherwise("length").alias("kind"))
    kind = F.when(F.col("o_orderstatus") == "F", "prose").when(F.col("o_orderstatus") == "O", "table").otherwise("unknown")
    at = F.element_at(F.array(F.lit("s"), F.lit("s.b"), F.lit("s.b.c")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    found = S.with_required(orders, rules, ["o_orderkey"])
    return found.select("o_orderkey", "required", S.offered(kind).alias("offered"), S.form_of(at).alias("form"))


@query("""
WITH d AS (SELECT doc_id, n_chars AS body, doc_id % 3 AS token FROM documents), e AS (SELECT doc_id, -n_chars AS body, doc_id % 2 AS token FROM documents WHERE doc_id % 4 <> 0)
SELECT d.doc_id, CASE WHEN e.token = d.token THEN e.body ELSE d.body END AS body, CASE WHEN e.token = d.token THEN d.token + 1 ELSE d.token END AS token,
  CASE WHEN e.doc_id IS NULL THEN 'kept' WHEN e.token = d.token THEN 'changed' ELSE 'conflict' END AS state FROM d LEFT JOIN e USING (doc_id)
""")
def draft_edits(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    drafts = docs.select("doc_id", F.col("n_chars").alias("body"), (F.col("doc_id") % 3).alias("token"))
    edits = docs.where("doc_id % 4 <> 0").select("doc_id", (-F.col("n_chars")).alias("body"), (F.col("doc_id") % 2).alias("token"))
    return H.edited(drafts, edits, ["doc_id"], ["body"])


@query(r"""
SELECT event_id, '{"a b":["x' || event_id || ' y",{"k":"n' || chr(10) || 'm"}],"n":' || event_id || '}' AS cleaned, true AS same, event_id % 2 = 0 AS differs FROM events
""".replace("chr(10)", "'\\n'"))
def cleaned_data(spark: SparkSession, folder: str) -> DataFrame:
    """JSON made of events: hidden characters and odd spaces cleaned at any depth, and answers that say the same."""
    events = table(spark, folder, "events")
    number = F.col("event_id").cast("string")
    raw = F.concat(F.lit('{" a  b ":["x​'), number, F.lit(' y",{"k":"n\\r\\nm­"}],"n":'), number, F.lit("}"))
    blanks = F.concat(F.lit('{"k":["a  b",null,{"z":" "}],"n":'), number, F.lit("}"))
    plain = F.concat(F.lit('{"n":"'), number, F.lit(' ","k":[" a b"]}'))
    other = F.when(F.col("event_id") % 2 == 0, F.concat(plain, F.lit(" "))).otherwise(F.lit('{"n":"other"}'))
    return events.select("event_id", T.clean_data(raw).alias("cleaned"), V.same_value(blanks, plain).alias("same"), V.same_value(plain, other).alias("differs"))
