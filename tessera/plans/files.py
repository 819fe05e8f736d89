"""Queries that read documents, pages and conversations as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import absorb as A
from tessera.operators import commands as C
from tessera.plans.query import query
from tessera.session import table
from tessera.sources import files


def _files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.concat("lang", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    pages = table(spark, folder, "pages").select(F.concat(F.lit("p"), "page_id").alias("path"), F.lit("page.html").alias("name"), F.col("html").cast("binary").alias("content"))
    line = F.concat_ws("\t", F.col("turn").cast("string"), "role", F.regexp_replace("text", r"\s+", " "))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    threads = table(spark, folder, "conversations").groupBy("conv_id").agg(F.concat(F.lit("turn\trole\ttext\n"), rows).alias("body"))
    threads = threads.select(F.concat(F.lit("c"), "conv_id").alias("path"), F.lit("thread.tsv").alias("name"), F.col("body").cast("binary").alias("content"))
    return docs.unionByName(pages).unionByName(threads)


@query("""
SELECT 'text' AS format, count(*) AS n FROM documents UNION ALL SELECT 'html', count(*) FROM pages UNION ALL SELECT 'tsv', count(DISTINCT conv_id) FROM conversations
""")
def absorbed_formats(spark: SparkSession, folder: str) -> DataFrame:
    return files.absorbed(_files(spark, folder)).groupBy("format").agg(F.count("*").alias("n"))


@query("""
SELECT 'c' || conv_id AS path, count(*) AS table_rows FROM conversations GROUP BY conv_id
""")
def absorbed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every thread that was read as a delimited file."""
    read = files.absorbed(_files(spark, folder).where("name = 'thread.tsv'"))
    return read.select("path", F.size(F.filter("units", lambda u: u["kind"] == "table_row")).cast("long").alias("table_rows"))


def _nested_mails(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation as a mail that holds the mail of the second turn, which holds the third, which holds all others; each has the first turn's text as a note."""
    turns = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    head = lambda x: F.concat(F.lit("From: "), x["role"], F.lit("@intranet"), F.lit("\nSubject: turn "), x["turn"].cast("string"), F.lit("\nMIME-Version: 1.0\n"))
    part = lambda kind, body: F.concat(F.lit("--cut"), body["n"], F.lit(f"\nContent-Type: {kind}\n"), body["head"], F.lit("\n"), body["text"], F.lit("\n"))

    def mail_of(inner: Column, x: Column) -> Column:  # of the mails that it holds, and its turn
        n = x["turn"].cast("string")
        made = lambda extra, text: F.struct(n.alias("n"), F.lit(extra).alias("head"), text.alias("text"))
        said = part('text/plain; charset="utf-8"', made("Content-Transfer-Encoding: 8bit\n", x["text"]))
        note = part('text/plain; charset="utf-8"; name="note.txt"', made('Content-Disposition: attachment; filename="note.txt"\nContent-Transfer-Encoding: 8bit\n', F.get("t", F.lit(0))["text"]))
        inside = F.array_join(F.transform(inner, lambda m: part("message/rfc822", made("Content-Disposition: attachment\n", m))), "")
        return F.concat(head(x), F.lit('Content-Type: multipart/mixed; boundary="cut'), n, F.lit('"\n\n'), said, note, inside, F.lit("--cut"), n, F.lit("--\n"))

    none = F.array().cast("array<string>")
    others = F.transform(F.slice("t", 4, F.size("t")), lambda x: mail_of(none, x))
    whole = F.aggregate(F.reverse(F.slice("t", 1, 3)), others, lambda inner, x: F.array(mail_of(inner, x)))[0]
    return turns.select("conv_id", F.concat(F.lit("c"), "conv_id").alias("path"), F.lit("thread.eml").alias("name"), whole.cast("binary").alias("content"))


@query("""
WITH t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
s AS (SELECT conv_id, least(n, 3) AS depth, 'mail' AS format, 'parsed' AS status, role || '@intranet' AS sender FROM t
UNION ALL SELECT conv_id, least(n, 3) + 1, 'text', CASE WHEN n = 0 THEN 'parsed' ELSE 'repeat' END, role || '@intranet' FROM t)
SELECT conv_id, CAST(depth AS INTEGER) AS depth, format, status, sender, CAST(count(*) AS INTEGER) AS sources FROM s GROUP BY ALL
""")
def absorbed_attachments(spark: SparkSession, folder: str) -> DataFrame:
    """Mails in mails to their end: notes that repeat are listed, and take the sender of the mail that they came with."""
    got = A.absorb(_nested_mails(spark, folder), case="conv_id")
    return got.groupBy("conv_id", "depth", "format", "status", "sender").agg(F.count("*").cast("int").alias("sources"))


@query(r"""
WITH t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, unnest(regexp_split_to_array(trim(text, ' ' || chr(10)), '\n[ \t]*\n')) AS p FROM conversations)
SELECT conv_id, CAST(least(n, 3) AS INTEGER) AS depth, role || '@intranet' AS sender, 'intranet' AS domain, trim(regexp_replace(regexp_replace(p, '[ \t]*\n[ \t]*', ' ', 'g'), '  +', ' ', 'g')) AS text FROM t WHERE trim(p) <> ''
""".replace("\\\\", "\\"))
def absorbed_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The paragraphs of these mails with who wrote them."""
    got = A.absorb(_nested_mails(spark, folder), case="conv_id").where("format = 'mail'")
    units = got.select("conv_id", "depth", F.explode("units").alias("u"))
    return units.select("conv_id", "depth", "u.sender", F.col("u.sender_domain").alias("domain"), F.trim(F.regexp_replace("u.text", "  +", " ")).alias("text"))


@query("""
SELECT * FROM (VALUES (1, 0, 'match LOT-\\d+'), (1, 2, 'passages with lot, batch and charge: Which lot?'), (2, 0, 'best passages: Why?')) t(question, command_no, said)
""".replace("\\\\", "\\"))
def commands_read(spark: SparkSession, folder: str) -> DataFrame:
    raw = [
        (1, '[{"kind":"pattern","pattern":"LOT-\\\\d+"},{"kind":"pattern","pattern":" "},{"kind":"keyword_ask","keywords":["lot"," batch","Lot","charge"],"ask":"Which lot?"},{"kind":"other"}]'),
        (2, '[{"kind":"ask","ask":"Why?"}]'),
        (3, "no json"),
    ]
    read = C.parsed(spark.createDataFrame(raw, "question int, commands string"), "question", "commands")
    return read.select("question", "command_no", C.described(F.col("kind"), F.col("pattern"), F.col("keywords"), F.col("ask")).alias("said"))
