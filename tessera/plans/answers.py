"""Queries over answers as JSON, made of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import conformance, schemas
from tessera.plans.query import query
from tessera.session import table
from tessera.streaming import guard


@query("""
WITH t AS (SELECT conv_id, role, length(text) > 200 AS told, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
f AS (SELECT conv_id, i, 0 AS k, '$.assignments[' || i || '].why: missing' AS fault FROM t WHERE NOT told AND i < 5
  UNION ALL SELECT conv_id, i, 1, '$.assignments[' || i || '].section: not one of the values' FROM t WHERE role <> 'user' AND i < 5)
SELECT c.conv_id, coalesce(string_agg(fault, '; ' ORDER BY i, k), '') AS faults, CASE WHEN count(fault) = 0 THEN any_value(least(n, 5)) END AS kept
FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c LEFT JOIN f USING (conv_id) GROUP BY c.conv_id
""")
def placements_conform(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as an answer that places passages: only users are a section, short turns do not say why, entries beyond the fifth are cut."""
    why = F.when(F.char_length("text") > 200, "long")
    entry = F.struct("turn", F.col("role").alias("section"), F.col("text").alias("quote"), why.alias("why"))
    answers = table(spark, folder, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("assignments"), F.lit(0.5).alias("confidence"))).alias("raw"))
    told = answers.select("conv_id", conformance.checked(F.col("raw"), schemas.placements(["user"], "none")).alias("c"))
    kept = F.size(F.from_json("c.value", "assignments array<struct<section:string,quote:string,why:string>>")["assignments"])
    return told.select("conv_id", F.array_join("c.faults", "; ").alias("faults"), F.when(F.col("c.value").isNotNull(), kept).cast("long").alias("kept"))


@query("""
SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click') THEN '$.result: not one of the values' WHEN value IS NULL THEN '$.confidence: missing' ELSE '' END AS faults FROM events
""")
def judgements_conform(spark: SparkSession, folder: str) -> DataFrame:
    """Events as judgements whose result is one of two kinds."""
    schema = schemas.record(result=schemas.one_of("view", "click"), reason="string", confidence="number")
    raw = F.to_json(F.struct(F.col("event_type").alias("result"), F.col("props").alias("reason"), F.col("value").alias("confidence"), "user_id"))
    return table(spark, folder, "events").select("event_id", F.array_join(conformance.checked(raw, schema)["faults"], "; ").alias("faults"))


@query("""
WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN k > 80 THEN 'padded' ELSE 'closed' END AS outcome, CASE WHEN k > 80 THEN 86 ELSE 6 + k + length(CAST(k AS VARCHAR)) END AS at FROM k
""")
def guarded_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The events' properties as answers with as many blanks as they say, in pieces of seven characters."""
    k = F.get_json_object("props", "$.k").cast("long")
    whole = F.concat(F.lit('{"k":'), F.repeat(F.lit(" "), k.cast("int")), k.cast("string"), F.lit("}"))
    cut = table(spark, folder, "events").select("event_id", F.posexplode(F.regexp_extract_all(F.concat(whole, F.lit(" {tail")), F.lit(r"(?s).{1,7}"), F.lit(0))).alias("seq", "piece"))
    return guard.guarded(cut, "event_id")
