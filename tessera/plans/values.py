"""Queries that read typed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V
from tessera.plans.query import query
from tessera.session import table

# Raw values with their kind and the key that makes equal ones meet.
RAW = [
    ("12,50 mm", "number", "12.5"), ("about 12.0", "number", "12"), ("-3", "number", "-3"), ("none", "number", ""), ("1.234,56", "number", "1.234"),
    ("2026-09-08", "date", "2026-09-08"), ("8.9.2026", "date", "2026-09-08"), ("on 08/09/2026 at noon", "date", "2026-09-08"), ("31.2.2026", "date", ""), ("8.9.26", "date", "2026-09-08"),
    ("Ja", "boolean", "true"), ("no", "boolean", "false"), ("maybe", "boolean", ""), (" nw-LL 88213. ", "identifier", "nw-ll88213"), ("(A/7)", "identifier", "a/7"),
    ("  Two   words! ", "text", "two words"), ("", "text", ""),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in RAW) + ") t(raw, kind, key)")
def value_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(a, b) for a, b, _ in RAW], "raw string, kind string")
    return rows.select("raw", "kind", V.key(F.col("raw"), F.col("kind")).alias("key"))


@query("""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, o_orderdate::DATE AS read FROM orders
""")
def date_key(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates written in five forms and read back."""
    form = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "d.M.yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = table(spark, folder, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "on ").otherwise(""), form).alias("raw"))
    return rows.select("o_orderkey", V.key(F.col("raw"), F.lit("date")).alias("iso"), V.date(F.col("raw")).alias("read"))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN true ELSE false END AS good FROM customer
""")
def boolean_key(spark: SparkSession, folder: str) -> DataFrame:
    words = F.when(F.col("c_acctbal") > 0, F.element_at(F.array(F.lit("Ja"), F.lit("true"), F.lit(" YES ")), (F.col("c_custkey") % 3 + 1).cast("int")))
    raw = words.otherwise(F.element_at(F.array(F.lit("Nein"), F.lit("falsch")), (F.col("c_custkey") % 2 + 1).cast("int")))
    return table(spark, folder, "customer").select("c_custkey", V.boolean(raw).alias("good"))


@query("""
SELECT c_custkey, lower(replace(c_name, ' ', '')) AS key FROM customer
""")
def identifier_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", V.identifier_key(F.concat(F.lit(" „"), "c_name", F.lit(".“ "))).alias("key"))


@query("""
SELECT doc_id, lower(trim(strip_accents(replace(regexp_extract(text, '^[^ ]+ [^ ]+ [^ ]+'), 'ß', 'ss')), '.,;:!?"''()[]{} ')) AS key FROM documents
""")
def text_key(spark: SparkSession, folder: str) -> DataFrame:
    """The first words of documents without marks and signs at their ends."""
    rows = table(spark, folder, "documents").select("doc_id", F.regexp_extract("text", "^[^ ]+ [^ ]+ [^ ]+", 0).alias("raw"))
    return T.with_deaccented(rows, "raw").select("doc_id", F.lower(T.edge_trimmed("raw")).alias("key"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS read, CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END AS flag FROM lineitem
""")
def form_values(spark: SparkSession, folder: str) -> DataFrame:
    none = F.array().cast("array<string>")
    raw = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(",0"))
    flag = F.when(F.col("l_returnflag") == "R", "x").otherwise("-")
    rows = table(spark, folder, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", V.form_value(raw, F.lit("number"), none).try_cast("double").cast("long").alias("read"), V.form_value(flag, F.lit("boolean"), none).alias("flag"))


@query("""
SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN true ELSE false END AS fits FROM part
""")
def choice_fits(spark: SparkSession, folder: str) -> DataFrame:
    options = F.array(*[F.lit(f"brand#{i}") for i in (1, 2, 3)])
    return table(spark, folder, "part").select("p_partkey", V.fits(V.text_key(F.concat(F.col("p_brand"), F.lit(" "))), F.lit("choice"), options).alias("fits"))


@query("""
SELECT s_suppkey, least(1.0, greatest(0.0, s_acctbal / 5000)) AS confidence FROM supplier
""")
def confidences(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select("s_suppkey", V.confidence((F.col("s_acctbal") / 5000).cast("string")).alias("confidence"))
