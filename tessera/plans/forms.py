"""Queries over the functions for texts, values and addresses, a row for each document, page or turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators import intake as I
from tessera.operators import specs as S
from tessera.operators import split as P
from tessera.plans.query import query
from tessera.session import table
from tessera.sources import mail, plain


@query(r"""
WITH d AS (SELECT doc_id, lang, source, text AS t FROM documents)
SELECT doc_id, regexp_replace('- ' || t, '^[\s\-*•·>–—.:;]+', '') AS without_marker,
  regexp_replace((doc_id % 9) || '. ' || t, '^\s*' || (doc_id % 9) || '\s*[.):\-–]\s*', '') AS without_number,
  CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN lang WHEN 2 THEN lang || ' and ' || source ELSE lang || ', ' || source || ' and z' END AS listed,
  (doc_id % 3) || CASE doc_id % 3 WHEN 1 THEN ' passage' ELSE ' passages' END AS counted,
  CASE doc_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE replace(lang, '_', ' ') END AS answer,
  'pg+x://u' || doc_id || ':***@h/' || lang AS hidden, trim(regexp_replace(t, '\s+', ' ', 'g')) = '' AS is_blank,
  trim(regexp_replace(t, '\s+', ' ', 'g'), '.,;:!?"''()[]{}<>«»„“”‚‘’ ') AS edges FROM d
""")
def text_forms(spark: SparkSession, folder: str) -> DataFrame:
    """How lines, titles, lists, counts, answers and addresses are shown."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", F.col("text").alias("t"))
    number = (F.col("doc_id") % 9).cast("string")
    some = F.slice(F.array("lang", "source", F.lit("z")), F.lit(1), (F.col("doc_id") % 4).cast("int"))
    answer = F.when(F.col("doc_id") % 3 == 0, "TRUE").when(F.col("doc_id") % 3 == 1, "false").otherwise(F.col("lang"))
    return docs.select(
        "doc_id", T.without_marker(F.concat(F.lit("- "), "t")).alias("without_marker"), T.without_number(F.concat(number, F.lit(". "), "t"), number).alias("without_number"),
        T.listed(some).alias("listed"), T.counted(F.col("doc_id") % 3, "passage").alias("counted"), T.answer_text(answer).alias("answer"),
        T.redacted_url(F.concat(F.lit("pg+x://u"), F.col("doc_id").cast("string"), F.lit(":secret@h/"), "lang")).alias("hidden"), T.blank("t").alias("is_blank"), T.edge_trimmed(T.collapse("t")).alias("edges"),
    )


@query(r"""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), k AS (SELECT doc_id, trim(regexp_replace(t, '[^a-z0-9]+', '_', 'g'), '_') AS k FROM d)
SELECT doc_id, CASE WHEN rtrim(left(k, 60), '_') = '' THEN 'question' ELSE rtrim(left(k, 60), '_') END AS slug FROM k
""")
def slugs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.slug("text").alias("slug"))


@query(r"""
WITH p AS (SELECT page_id, url, regexp_replace(lower(url), '[?#].*', '') AS u FROM pages), f AS (SELECT page_id, 'f' || page_id || CASE page_id % 7 WHEN 0 THEN '.TXT' WHEN 1 THEN '.csv' WHEN 2 THEN '.eml' WHEN 3 THEN '.html' WHEN 4 THEN '.zip' WHEN 5 THEN '' ELSE '.docx' END AS name, CASE page_id % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'image/x' ELSE 'none' END AS media FROM pages)
SELECT page_id, lower(regexp_extract(name, '^.+\.([^.]*)$', 1)) AS extension,
  CASE page_id % 7 WHEN 0 THEN 'text' WHEN 1 THEN 'csv' WHEN 2 THEN 'mail' WHEN 3 THEN 'html' WHEN 6 THEN 'docx' ELSE CASE page_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'image' END END AS format FROM f
""")
def file_formats(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    pick = lambda n, names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("page_id") % n + 1).cast("int"))
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"), pick(7, (".TXT", ".csv", ".eml", ".html", ".zip", "", ".docx")))
    media = pick(3, ("text/plain", "image/x", "none"))
    return pages.select("page_id", plain.extension(name).alias("extension"), plain.source_format(name, media).alias("format"))


@query(r"""
SELECT conv_id, turn, 'user' || conv_id || '@example' || turn || '.org' AS address, 'Turn ' || turn AS name, 'example' || turn || '.org' AS domain,
  CASE WHEN turn % 2 = 0 THEN make_date(2024, CAST(conv_id % 12 + 1 AS INTEGER), CAST(turn % 28 + 1 AS INTEGER)) END AS sent_on, ['a' || turn || '@b.de', 'c@d.fr'] AS every FROM conversations
""")
def mail_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Senders, domains, dates and lists of addresses of headers made of turns."""
    talk = table(spark, folder, "conversations")
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    header = F.concat(F.lit('From: "Turn '), turn, F.lit('" <User'), conv, F.lit("@Example"), turn, F.lit(".org>"))
    day, month = (F.col("turn") % 28 + 1).cast("string"), (F.col("conv_id") % 12 + 1).cast("string")
    line = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Am "), day, F.lit("."), month, F.lit(".2024 schrieb X:"))).otherwise("Am 31.02.2024 schrieb X:")
    found = mail.sender(header)
    listed = mail.addresses(F.concat(F.lit("To: A"), turn, F.lit("@b.de, C@D.fr")))
    return talk.select("conv_id", "turn", found["address"].alias("address"), found["name"].alias("name"), mail.domain_of(found["address"]).alias("domain"), mail.loose_date(line).alias("sent_on"), listed.alias("every"))


@query(r"""
SELECT conv_id, CAST(r.reply_no AS INTEGER) AS reply_no, r.text FROM (SELECT conv_id, unnest(list_transform(range(0, len(t)), lambda i: struct_pack(reply_no := i, text := t[i + 1]))) AS r
  FROM (SELECT conv_id, list(trim(regexp_replace(regexp_replace(text, '\r\n?', ' ', 'g'), '\n', ' ', 'g')) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)) WHERE r.text <> ''
""")
def thread_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations written as one mail with a separator before each turn but the first, and cut again."""
    line = F.btrim(F.regexp_replace(F.regexp_replace("text", r"\r\n?", " "), "\n", " "))
    said = F.when(F.col("turn") == F.col("first"), line).otherwise(F.concat(F.lit("-- Original Message --\n"), line))
    talk = table(spark, folder, "conversations")
    talk = talk.join(talk.groupBy("conv_id").agg(F.min("turn").alias("first")), "conv_id")
    bodies = talk.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    return mail.replies(bodies, "conv_id", "body").select("conv_id", "reply_no", "text")


@query(r"""
WITH o AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber % 6 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-02-28' WHEN 2 THEN '1e5' WHEN 3 THEN 'x' WHEN 4 THEN '20240229' ELSE ' ' END AS v FROM lineitem)
SELECT k, n, v AS value, n % 6 IN (1, 4) AS is_date, n % 6 IN (2, 4) AS is_number, n % 6 = 3 AS is_choice FROM o
""")
def cell_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Cells that are values of a column's kind and cells that are none."""
    cells = F.array(*[F.lit(x) for x in ("2024-02-30", "2024-02-28", "1e5", "x", "20240229", " ")])
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.element_at(cells, (F.col("l_linenumber") % 6 + 1).cast("int")).alias("value"))
    options = F.array(F.lit("x"), F.lit("y"))
    kind = lambda name: V.parses_as(F.col("value"), F.lit(name), options)
    return rows.select("k", "n", "value", kind("date").alias("is_date"), kind("number").alias("is_number"), kind("enum").alias("is_choice"))


@query(r"""
SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber % 6 WHEN 0 THEN '2024-02-30' WHEN 3 THEN 'x' WHEN 2 THEN '1e5' END AS value FROM lineitem WHERE l_linenumber % 6 IN (0, 2, 3)
""")
def bad_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of :func:`cell_kinds` that a check of dates finds."""
    from tessera.operators.checks import bad_cells as bad

    cells = cell_kinds(spark, folder).select("k", "n", "value")
    return bad(cells, F.lit("date"), F.array().cast("array<string>"))


@query(r"""
SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS chars, true AS in_size FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''
""")
def parts_hold_all(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of 1200 code points and 15 per cent more at most have every character of their text that is no blank."""
    parts = P.split_parts(table(spark, folder, "documents"), "doc_id", "text", 1200)
    return parts.groupBy("doc_id").agg(F.sum(F.char_length(F.regexp_replace("part", r"\s", ""))).alias("chars"), F.bool_and(F.char_length("part") <= 1380).alias("in_size"))


@query(r"""
SELECT doc_id, true AS slices, true AS in_budget, true AS in_order, length(regexp_replace(text, '\s', '', 'g')) AS chars FROM documents WHERE text <> '' AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''
""")
def passages_hold_all(spark: SparkSession, folder: str) -> DataFrame:
    """Passages are slices of their text, within the budget, and together have every character that is no blank."""
    docs = table(spark, folder, "documents")
    unit = F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"))
    found = P.passages(docs.select("doc_id", F.array(unit).alias("units")), "doc_id", "units").join(docs.select("doc_id", F.col("text").alias("source")), "doc_id")
    same = F.substring("source", F.col("char_from") + 1, F.col("char_to") - F.col("char_from")) == F.col("text")
    ends = F.transform(F.array_sort(F.collect_list(F.struct("seq", "char_from", "char_to"))), lambda p: p)
    held = F.aggregate(ends, F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda s, p: F.struct(p["char_to"].alias("at"), (s["ok"] & (p["char_from"] < p["char_to"])).alias("ok")), lambda s: s["ok"])
    fresh = F.char_length(F.regexp_replace("text", r"\s", ""))
    return found.groupBy("doc_id").agg(F.bool_and(same).alias("slices"), F.bool_and(F.char_length("text") <= 1800).alias("in_budget"), held.alias("in_order"), F.sum(fresh).alias("chars"))


@query(r"""
WITH p AS (SELECT doc_id, lang AS section, CASE doc_id % 4 WHEN 0 THEN left(text, 30) WHEN 1 THEN 'not in the text at all' WHEN 2 THEN left(text, 20) ELSE ' ' END AS quote, doc_id % 4 AS k, doc_id % 5 AS part_no, text FROM documents)
SELECT doc_id, CASE WHEN section = 'de' THEN 'unplaced' WHEN section = 'fr' THEN 'discarded' WHEN k IN (0, 2) AND trim(regexp_replace(quote, '\s+', ' ', 'g')) <> '' THEN 'placed' ELSE 'discarded' END AS state FROM p
""")
def placements_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes of documents filed under their language: one section is nowhere, one is unknown."""
    quote = F.when(F.col("doc_id") % 4 == 0, F.substring("text", 1, 30)).when(F.col("doc_id") % 4 == 1, "not in the text at all").when(F.col("doc_id") % 4 == 2, F.substring("text", 1, 20)).otherwise(" ")
    placed = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("section"), quote.alias("quote"), "text")
    sections = placed.select("section").where("section <> 'fr'").distinct()
    return I.checked(placed, sections, "de").select("doc_id", "state")


@query(r"""
WITH p AS (SELECT o_custkey AS section, o_orderkey % 7 AS part_no, o_orderkey AS ord, o_orderpriority AS quote, (o_orderkey % 8) / 8.0 AS confidence FROM orders),
m AS (SELECT section, lower(quote) AS q, min_by(part_no, part_no * 1000000000 + ord) AS part_no, count(*) AS times FROM p GROUP BY 1, 2),
c AS (SELECT section, round(avg(c), 6) AS confidence FROM (SELECT section, part_no, avg(confidence) AS c FROM p GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT section, list_sort(list(DISTINCT part_no))[1:3] AS part_nos FROM p GROUP BY 1)
SELECT m.section, m.q AS quote, m.part_no, t.part_nos, c.confidence FROM m JOIN c ON c.section = m.section JOIN t ON t.section = m.section
""")
def placements_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as placements under their customer: repeats merged, the parts they are from, and how sure they are."""
    orders = table(spark, folder, "orders")
    rows = orders.select(F.col("o_custkey").alias("section"), (F.col("o_orderkey") % 7).alias("part_no"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("quote"), (F.col("o_orderkey") % 8 / 8.0).alias("confidence"))
    merged = I.merged(rows, ["section"]).select("section", F.lower("quote").alias("quote"), "part_no")
    sure = I.part_confidence(rows, ["section"])
    return merged.join(sure, "section").join(I.section_context(rows, ["section"]), "section")


@query(r"""
SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'asia' ELSE CAST(n_regionkey AS VARCHAR) END AS region, CASE WHEN n_nationkey % 3 = 0 THEN 'area' WHEN n_nationkey % 3 = 1 THEN 'area.size' ELSE 'areal.size' END AS path,
  concat_ws(chr(10) || chr(10), 'general', CASE WHEN n_nationkey % 2 = 0 THEN n_name END) AS style FROM nation
""")
def renamed_keys(spark: SparkSession, folder: str) -> DataFrame:
    """References after a key was renamed, and layered styles."""
    nation = table(spark, folder, "nation").withColumn("region", F.col("n_regionkey").cast("string"))
    path = F.element_at(F.array(F.lit("zone"), F.lit("zone.size"), F.lit("areal.size")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    found = S.renamed(nation, F.lit("2"), F.lit("asia"), "region")
    style = S.layered_style(F.lit(" general "), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(" "))
    return found.select("n_nationkey", "region", S.renamed_path(path, "zone", "area").alias("path"), style.alias("style"))


@query(r"""
WITH w AS (SELECT doc_id, text, strpos(text, 'token') AS place FROM documents WHERE contains(text, 'token'))
SELECT doc_id, CAST(least(place - 1, 40) AS INTEGER) AS room, true AS held FROM w
""")
def windows_around(spark: SparkSession, folder: str) -> DataFrame:
    """The words around a span hold it, and go no further than they may."""
    docs = table(spark, folder, "documents").where(F.contains("text", F.lit("token")))
    at = F.instr("text", "token") - 1
    shown = T.window("text", at, at + 5, 40)
    near = T.context("text", at, at + 5, 40)
    held = F.contains(shown, F.lit("token")) & F.contains(near, F.lit("token")) & (F.char_length(shown) <= 87) & (F.char_length(near) <= 85)
    return docs.select("doc_id", F.least(at, F.lit(40)).cast("int").alias("room"), held.alias("held"))
