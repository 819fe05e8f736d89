"""Queries over the event log and the history of revisions it stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import events as E
from tessera.operators import history as H
from tessera.plans.query import query
from tessera.session import table


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", "user_id", F.col("ts").alias("at"), F.col("event_type").alias("category"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("duration"), "props"
    )


@query("""
SELECT event_type AS category, event_type <> 'error' AS ok, count(*) AS n FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1, 2
""")
def event_day_counts(spark: SparkSession, folder: str) -> DataFrame:
    return E.counts_since(_log(spark, folder), 24)


@query("""
SELECT CAST(user_id AS BIGINT) AS user_id, count(*) AS calls, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failures,
  CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS seconds, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens
FROM events GROUP BY 1
""")
def event_spend(spark: SparkSession, folder: str) -> DataFrame:
    return E.spend(_log(spark, folder), ["user_id"], tokens=F.get_json_object("props", "$.k").cast("long"))


@query("""
SELECT event_id, event_type AS category FROM (SELECT *, rank() OVER (ORDER BY ts DESC) AS r FROM events) WHERE r <= 500
""")
def log_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return H.kept_newest(_log(spark, folder), "at", 500).select("event_id", "category")


@query("""
SELECT user_id, count(*) AS payloads FROM events
WHERE ts >= (SELECT min(ts) FROM (SELECT ts FROM events ORDER BY ts DESC LIMIT 500)) GROUP BY user_id
""")
def rotated_payloads(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    payloads = log.select(F.col("event_id").alias("of_event"), "user_id")
    return H.cascaded(payloads, H.kept_newest(log, "at", 500), "of_event", "event_id").groupBy("user_id").agg(F.count("*").alias("payloads"))


@query("""
SELECT user_id, event_id, event_type AS category, value AS duration FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def latest_revision(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder).select("user_id", "event_id", "category", "duration", "at")
    return H.latest(log, ["user_id"], [F.col("at"), F.col("event_id")]).drop("at")


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events
""")
def revision_history(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    log = H.numbered(_log(spark, folder), ["user_id"], [F.col("at"), F.col("event_id")])
    return log.select("user_id", "event_id", "seq", F.lag("category").over(Window.partitionBy("user_id").orderBy("seq")).alias("previous"))


@query("""
WITH old AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events WHERE event_id % 2 = 0),
top AS (SELECT user_id, max(seq) AS t FROM old GROUP BY user_id)
SELECT * FROM old UNION ALL
SELECT e.user_id, e.event_id, coalesce(t, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS seq
FROM events e LEFT JOIN top USING (user_id) WHERE e.event_id % 2 = 1
""")
def next_seq(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", "event_id")
    old = H.numbered(rows.where("event_id % 2 = 0"), ["user_id"], [F.col("event_id")])
    return H.appended(old, rows.where("event_id % 2 = 1"), ["user_id"], [F.col("event_id")])


@query("""
SELECT user_id, event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50
""")
def recent_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50)


@query("""
WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n_events,
  CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS step FROM events GROUP BY user_id)
SELECT user_id, status, n_events, CAST(floor(100 * step / n_events) AS BIGINT) AS percent FROM s
""")
def job_states(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    state = H.states(log, ["user_id"], [F.col("at"), F.col("event_id")], "category")
    steps = log.groupBy("user_id").agg(F.count_if(F.col("category") == "view").alias("step"))
    return state.join(steps, "user_id").select("user_id", "status", "n_events", H.percent(F.col("step"), F.col("n_events")).alias("percent"))


@query("""
WITH p AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'view' THEN 'pending' WHEN event_type = 'purchase' THEN 'accepted' ELSE 'rejected' END AS status FROM events),
l AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM p)
SELECT event_id, CASE WHEN status = 'pending' AND later IS NOT NULL THEN 'superseded' ELSE status END AS status FROM l
""")
def proposal_states(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("category") == "view", "pending").when(F.col("category") == "purchase", "accepted").otherwise("rejected")
    log = _log(spark, folder).withColumn("status", status)
    return H.superseded(log, ["user_id"], [F.col("at"), F.col("event_id")], "status").select("event_id", "status")


@query("""
SELECT user_id, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 6
""")
def last_remarks(spark: SparkSession, folder: str) -> DataFrame:
    return H.newest_per(table(spark, folder, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 6).select("user_id", "event_id", "value")


@query("""
SELECT event_type, CASE event_type WHEN 'click' THEN 'Clicked' WHEN 'signup' THEN 'Joined' ELSE upper(substr(event_type, 1, 1)) || substr(event_type, 2) END AS label,
  round(round_even(count(*) / 86.4, 1), 1) AS per_second FROM events GROUP BY event_type
""")
def event_labels(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.select("event_type", E.readable(F.col("event_type"), {"click": "Clicked", "signup": "Joined"}).alias("label"), E.per_second(F.col("n"), F.lit(86400.0)).alias("per_second"))


@query("""
SELECT 'events' AS table_name, count(*) AS n FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'labels', count(*) FROM labels
""")
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    return E.table_counts({n: table(spark, folder, n) for n in ("events", "documents", "labels")})


@query("""
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2
""")
def event_hours(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))
