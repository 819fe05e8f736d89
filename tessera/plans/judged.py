"""Queries over answers, judgements, pins and versions, made of the tables' own values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import answers as A
from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators import checks as C
from tessera.operators import gate as G
from tessera.operators import history as H
from tessera.operators import intake as I
from tessera.operators import specs as S
from tessera.plans.query import query
from tessera.session import table

LINE_SQL = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with their number in the order of their dates, since line numbers repeat."""
    from pyspark.sql import Window

    over = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return table(spark, folder, "lineitem").withColumn("n", F.row_number().over(over))


@query(f"""
WITH l AS (SELECT l_orderkey, l_returnflag, l_linestatus, {LINE_SQL} AS n FROM lineitem), m AS (SELECT l_orderkey, max(n) AS n FROM l GROUP BY 1)
SELECT l_orderkey AS call, n AS attempt, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'unavailable' WHEN l_returnflag = 'N' THEN 'ok' ELSE 'malformed' END AS state FROM l JOIN m USING (l_orderkey, n)
""")
def last_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as calls, their lines as attempts."""
    rows = _lines(spark, folder).select(F.col("l_orderkey").alias("call"), F.col("n").alias("attempt"), "l_returnflag", "l_linestatus")
    told = A.last_attempt(rows, "call", "attempt", F.col("l_returnflag") == "N", ~((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")))
    return told.select("call", "attempt", "state")


@query("""
WITH t AS (SELECT l_suppkey AS topic, trim(p_type) AS term, lower(p_type) AS name, l_orderkey * 1000000 + p_partkey AS ord FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 25),
k AS (SELECT DISTINCT l_suppkey AS topic, lower(p_type) AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 48)
SELECT topic, count(*) AS terms, min(name) AS first FROM (SELECT DISTINCT topic, name FROM t ANTI JOIN k USING (topic, name)) GROUP BY topic
""")
def fresh_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Types of small parts as terms that suppliers propose, those of large ones are known."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.select(F.col("l_suppkey").alias("topic"), F.concat(F.lit(" "), F.upper("p_type")).alias("term"), (F.col("l_orderkey") * 1_000_000 + F.col("p_partkey")).alias("ord"), "p_size")
    fresh = A.fresh_terms(rows.where("p_size <= 25"), rows.where("p_size > 48"), "topic", "term", "ord")
    return fresh.groupBy("topic").agg(F.count("*").alias("terms"), F.min(F.lower("term")).alias("first"))


@query(f"""
WITH l AS (SELECT l_orderkey, l_quantity, l_returnflag, {LINE_SQL} AS n FROM lineitem)
SELECT l_orderkey, n FROM l WHERE l_quantity BETWEEN 1 AND 30 AND l_returnflag <> 'A'
""")
def captions_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as captions: their quantity is the image they name, accepted ones say nothing."""
    said = F.when(F.col("l_returnflag") == "A", " \n").otherwise(F.col("l_returnflag"))
    rows = _lines(spark, folder).select("l_orderkey", "n", F.col("l_quantity").cast("long").cast("string").alias("image"), said.alias("caption"))
    return A.captions_kept(rows, "image", "caption", F.lit(30)).select("l_orderkey", "n")


@query(r"""
WITH p AS (SELECT conv_id AS block, turn, left(text, 30) AS passage, lower(trim(regexp_replace(left(text, 30), '\s+', ' ', 'g'))) AS k FROM conversations),
d AS (SELECT *, row_number() OVER (PARTITION BY block, replace(k, 'ß', 'ss') ORDER BY turn) AS nth FROM p),
f AS (SELECT conv_id AS block, arg_min(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss'), turn) AS s FROM conversations GROUP BY 1)
SELECT block, turn, NOT (k <> '' AND contains(s, replace(k, 'ß', 'ss'))) AS stale FROM d JOIN f USING (block) WHERE nth = 1
""")
def pins_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Beginnings of turns as pins, each once; stale where the conversation's first turn does not have them."""
    talk = table(spark, folder, "conversations")
    pins = talk.select(F.col("conv_id").alias("block"), "turn", F.substring("text", 1, 30).alias("passage"), F.col("turn").alias("pinned_at"), F.col("turn").alias("pin_id"))
    pins = I.distinct_pins(pins)
    first = talk.groupBy(F.col("conv_id").alias("block")).agg(F.min_by("text", "turn").alias("text"))
    stale = I.stale_pins(pins, first).select("block", "turn").withColumn("stale", F.lit(True))
    return pins.select("block", "turn").join(stale, ["block", "turn"], "left").fillna(False, ["stale"])


@query(r"""
WITH t AS (SELECT conv_id, turn, role, text, left(text, 25) AS q, replace(lower(trim(regexp_replace(left(text, 25), '\s+', ' ', 'g'))), 'ß', 'ss') AS k FROM conversations),
w AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS whole FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT conv_id, turn FROM t JOIN w USING (conv_id) WHERE role <> 'system' AND k <> '' AND contains(replace(lower(trim(regexp_replace(whole, '\s+', ' ', 'g'))), 'ß', 'ss'), k) AND NOT turn <= 1
""")
def prefilled_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as proposed answers with their beginning as quote, found in what the assistant said; a person answered the first two."""
    talk = table(spark, folder, "conversations")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    whole = talk.where("role = 'assistant'").groupBy("conv_id").agg(said.alias("whole"))
    rows = talk.join(whole, "conv_id").select("conv_id", "turn", (F.col("role") != "system").alias("found"), F.lit(True).alias("fits"), F.col("text").alias("value"), F.substring("text", 1, 25).alias("quote"), F.col("whole").alias("text"))
    answers = talk.where("turn <= 1").select("conv_id", "turn", F.lit("user").alias("source"))
    return I.prefilled(rows, answers, ["conv_id", "turn"]).select("conv_id", "turn")


@query(f"""
WITH l AS (SELECT l_orderkey, l_returnflag AS v, l_linestatus AS q, {LINE_SQL} AS n FROM lineitem), w AS (SELECT *, lag(v) OVER x AS ov, lag(q) OVER x AS oq FROM l WINDOW x AS (PARTITION BY l_orderkey ORDER BY n))
SELECT l_orderkey, n, CASE WHEN v IS NOT DISTINCT FROM ov THEN coalesce(CASE WHEN q = 'O' THEN q END, oq) ELSE CASE WHEN q = 'O' THEN q END END AS quote FROM w
""")
def quotes_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as answers that follow each other: a value that stays keeps its quote, of which only open lines bring one."""
    from pyspark.sql import Window

    over = Window.partitionBy("l_orderkey").orderBy("n")
    rows = _lines(spark, folder).withColumns({"ov": F.lag("l_returnflag").over(over), "oq": F.lag("l_linestatus").over(over)})
    brought = F.when(F.col("l_linestatus") == "O", F.col("l_linestatus"))
    return rows.select("l_orderkey", "n", I.quote_kept(F.col("ov"), F.col("l_returnflag"), F.col("oq"), brought).alias("quote"))


@query("""
SELECT doc_id, CASE WHEN n_chars // 100 > 40 THEN 40 ELSE greatest(n_chars // 100, 5 * length(lang)) END AS most FROM documents
""")
def placement_ceiling(spark: SparkSession, folder: str) -> DataFrame:
    """How many placements each document may give, with as many sections as its language has letters."""
    return table(spark, folder, "documents").select("doc_id", I.ceiling(F.char_length("lang"), F.col("n_chars")).cast("long").alias("most"))


@query(r"""
WITH p AS (SELECT conv_id, turn, left(text, 20) AS point, CASE WHEN role = 'user' THEN right(text, 30) ELSE 'nowhere in any text' END AS quote, text, role FROM conversations),
g AS (SELECT conv_id, point, bool_or(turn % 2 = 0 AND replace(lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))), 'ß', 'ss') <> '' AND contains(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss'), replace(lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))), 'ß', 'ss'))) AS ok FROM p GROUP BY 1, 2)
SELECT conv_id, count(*) FILTER (NOT ok) AS missing, CASE WHEN count(*) FILTER (NOT ok) = 0 THEN 'pass' ELSE 'fail' END AS outcome FROM g GROUP BY 1
""")
def mentions_check(spark: SparkSession, folder: str) -> DataFrame:
    """Beginnings of turns as points, established by even turns whose users' ends are quoted."""
    talk = table(spark, folder, "conversations")
    point = F.substring("text", 1, 20).alias("point")
    quote = F.when(F.col("role") == "user", F.right("text", F.lit(30))).otherwise("nowhere in any text")
    answers = talk.select("conv_id", point, (F.col("turn") % 2 == 0).alias("established"), quote.alias("quote"), "text")
    found = C.mentions(talk.select("conv_id", point).distinct(), answers, ["conv_id"], "point", "quote", "text")
    return found.select("conv_id", F.size("missing").cast("long").alias("missing"), "outcome")


@query("""
SELECT event_id, CASE WHEN value IS NULL THEN 'error' ELSE 'fail' END AS outcome FROM events
UNION ALL SELECT doc_id, CASE WHEN quality IS NULL THEN 'error' WHEN quality = 1 THEN 'pass' ELSE 'not_applicable' END FROM labels
""")
def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as words that no judge may say, labels as words that one may."""
    events = table(spark, folder, "events").select("event_id", C.verdict(F.col("event_type"), F.col("value").isNotNull()).alias("outcome"))
    word = F.when(F.col("quality") == 1, " Pass ").otherwise("NOT_applicable")
    return events.unionByName(table(spark, folder, "labels").select(F.col("doc_id").alias("event_id"), C.verdict(word, F.col("quality").isNotNull()).alias("outcome")))


@query(f"""
WITH l AS (SELECT l_orderkey, l_returnflag, l_linestatus, 'r' || lpad(CAST({LINE_SQL} AS VARCHAR), 3, '0') AS r FROM lineitem),
x AS (SELECT l_orderkey, r, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 3 WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 0 WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS k, CASE WHEN l_returnflag = 'R' THEN ' returned' ELSE '' END AS why FROM l)
SELECT l_orderkey AS document, string_agg(CASE k WHEN 0 THEN 'BLOCKER ' WHEN 1 THEN 'WARNING ' WHEN 2 THEN 'PASS ' ELSE 'PENDING ' END || r || why, chr(10) ORDER BY k, r) AS report FROM x GROUP BY 1
""")
def gate_report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as results: returned ones fail, open new ones have none."""
    outcome = F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), None).when(F.col("l_returnflag") == "R", "fail").otherwise("pass")
    severity = F.when(F.col("l_linestatus") == "F", "blocker").otherwise("warning")
    reason = F.when(F.col("l_returnflag") == "R", "returned")
    name = F.concat(F.lit("r"), F.lpad(F.col("n").cast("string"), 3, "0"))
    return G.report_lines(_lines(spark, folder).select(F.col("l_orderkey").alias("document"), name.alias("requirement"), severity.alias("severity"), outcome.alias("outcome"), reason.alias("reason")))


@query("""
SELECT key, CASE WHEN a AND NOT b THEN 'created' ELSE 'dropped' END AS change FROM (SELECT l_partkey AS key, bool_or(l_linestatus = 'O') AS a, bool_or(l_linestatus = 'F') AS b FROM lineitem GROUP BY 1) WHERE a <> b
""")
def listing_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of finished lines as a listing before, of open ones after."""
    lines = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("key"), "l_linestatus")
    return H.snapshot_diff(lines.where("l_linestatus = 'F'"), lines.where("l_linestatus = 'O'"), "key")


@query("""
WITH v AS (SELECT p_brand, p_size, min(p_name) AS name FROM part GROUP BY 1, 2)
SELECT p_brand, p_size, name FROM v WHERE p_size <= 20 UNION ALL SELECT p_brand, p_size + 5, 'new' FROM v WHERE p_size <= 20 AND (p_brand, p_size + 5) NOT IN (SELECT p_brand, p_size FROM v WHERE p_size <= 20)
""")
def published_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of a brand as versions; those five larger are published unless they are there."""
    versions = table(spark, folder, "part").where("p_size <= 20").groupBy("p_brand", "p_size").agg(F.min("p_name").alias("name"))
    new = versions.select("p_brand", (F.col("p_size") + 5).alias("p_size"), F.lit("new").alias("name"))
    return S.published(versions, new, "p_brand", "p_size")


@query("""
SELECT l_orderkey, l_linenumber, 'S' || l_orderkey || '.b must have at least ' || CAST(l_quantity AS BIGINT) || CASE WHEN l_returnflag = 'R' THEN ' and at most ' || CAST(l_quantity * 2 AS BIGINT) ELSE '' END || CASE WHEN l_linestatus = 'F' THEN ' rows' ELSE ' words' END AS said FROM lineitem
""")
def rule_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as rules in words."""
    whole = lambda c: c.cast("long").cast("string")
    most = F.when(F.col("l_returnflag") == "R", whole(F.col("l_quantity") * 2))
    params = F.map_filter(F.create_map(F.lit("min"), whole(F.col("l_quantity")), F.lit("max"), most), lambda _, v: v.isNotNull())
    kind = F.when(F.col("l_linestatus") == "F", "rows").otherwise("length")
    place = F.concat(F.lit("S"), F.col("l_orderkey").cast("string"), F.lit(".b"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", S.sentence(kind, place, params).alias("said"))


@query(r"""
WITH t AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN right(text, 10) ELSE reverse(left(text, 10)) END AS quote FROM conversations)
SELECT conv_id, turn, contains(replace(lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')), 'ß', 'ss'), replace(lower(regexp_replace(quote, '[^\p{L}\p{N}]+', '', 'g')), 'ß', 'ss')) AS says_no_more FROM t
""")
def quotes_that_say_no_more(spark: SparkSession, folder: str) -> DataFrame:
    """A turn's end says no more than the turn, whatever its signs; its beginning read backwards does."""
    quote = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("«"), F.right("text", F.lit(10)), F.lit("!»"))).otherwise(F.reverse(F.substring("text", 1, 10)))
    return table(spark, folder, "conversations").select("conv_id", "turn", T.says_no_more(quote, F.col("text")).alias("says_no_more"))


@query("""
SELECT o_orderkey, o_orderstatus = 'F' OR o_totalprice > 200000 AS says FROM orders
""")
def rows_with_content(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as rows of a form: a check box alone is no content."""
    status, price = F.when(F.col("o_orderstatus") == "F", "F").otherwise(" "), F.when(F.col("o_totalprice") > 200_000, F.col("o_totalprice").cast("string"))
    row = F.create_map(F.lit("status"), status, F.lit("price"), price, F.lit("box"), F.col("o_orderpriority"))
    return table(spark, folder, "orders").select("o_orderkey", V.row_has_content(row, F.array(F.lit("box"))).alias("says"))
