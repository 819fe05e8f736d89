"""Queries that report: findings as JSON, what runs came to, exports with their gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import extraction as X
from tessera.operators import gate as G
from tessera.plans.query import query
from tessera.session import table


@query("""
WITH q AS (SELECT event_type AS question, props AS quote, min(event_id) AS ord, list_sort(list(DISTINCT CAST(user_id AS VARCHAR))) AS vs FROM events GROUP BY 1, 2)
SELECT question, '[' || string_agg('{"quote":' || to_json(quote) || ',"values":' || to_json(vs) || '}', ',' ORDER BY ord) || ']' AS json FROM q GROUP BY question
""")
def findings_json(spark: SparkSession, folder: str) -> DataFrame:
    """Events as findings: users by what was said of them."""
    found = table(spark, folder, "events").select(F.col("event_type").alias("question"), F.col("user_id").cast("string").alias("value"), F.col("props").alias("quote"), F.col("event_id").alias("ord"))
    return X.findings_json(found)


@query("""
SELECT event_type AS run, count(DISTINCT user_id) AS sources, count(DISTINCT props) AS passages, count(*) FILTER (value IS NOT NULL AND value > 50) AS calls, 0 AS errors, count(*) FILTER (value IS NOT NULL) AS found,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 3) AS seconds FROM events WHERE value IS NOT NULL GROUP BY 1
""")
def run_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of events as runs."""
    events = table(spark, folder, "events")
    tier = F.when(F.col("value") > 50, 2).otherwise(0)
    outcome = F.when(F.col("value").isNotNull(), "found")
    return X.run_rows(events.select(F.col("event_type").alias("run"), F.col("user_id").alias("source"), F.col("props").alias("passage"), tier.alias("tier"), outcome.alias("outcome"), F.col("ts").alias("began"), F.col("ts").alias("ended")))


@query("""
WITH g AS (SELECT l_orderkey AS document, count(*) FILTER (l_returnflag = 'R') AS blockers, count(*) FILTER (l_returnflag = 'A') AS warnings FROM lineitem GROUP BY 1),
e AS (SELECT o_orderkey AS document, trim(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE ' ' END) AS reason, blockers, warnings FROM orders LEFT JOIN g ON o_orderkey = document)
SELECT document, CASE WHEN coalesce(blockers, 1) > 0 AND reason <> '' THEN reason END AS reason, CASE WHEN blockers = 0 OR reason <> '' THEN 'exported' ELSE 'blocked' END AS state,
  CASE WHEN blockers IS NOT NULL THEN '{"blockers":' || blockers || ',"warnings":' || warnings || ',"passed":' || (blockers = 0) || '}' END AS gate FROM e
""")
def export_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as documents to export: urgent ones give a reason."""
    sums = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("document")).agg(F.count_if(F.col("l_returnflag") == "R").alias("blockers"), F.count_if(F.col("l_returnflag") == "A").alias("warnings"))
    reason = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderpriority")).otherwise(" ")
    exports = table(spark, folder, "orders").select(F.col("o_orderkey").alias("document"), reason.alias("reason"))
    return G.export_records(exports, sums.withColumn("passed", F.col("blockers") == 0))
