"""Queries over orders as sections of their customers' documents, their lines as what was done to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators import rewrite as W
from tessera.operators import sections as S
from tessera.plans.query import query
from tessera.session import table

BY = ["document", "section"]
ORDER = ["at", "line", "part", "price", "flag", "quantity"]


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("section"))


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as events: accepted ones complete, returned ones mark as stale, small ones reopen, others edit."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("section"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity")
    )
    kind = F.when(F.col("quantity") < 6, "reopen").when(F.col("flag") == "A", "complete").when(F.col("flag") == "R", "mark_stale").otherwise("edit")
    return lines.join(_orders(spark, folder), "section").withColumn("kind", kind)


def _needs(spark: SparkSession, folder: str) -> DataFrame:
    """Each order rests on its customer's order before."""
    before = F.lag("section").over(Window.partitionBy("document").orderBy("section"))
    return _orders(spark, folder).withColumn("depends_on", before).where("depends_on is not null")


LOG_SQL = """
WITH o AS (SELECT o_custkey AS document, o_orderkey AS section, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders),
l AS (SELECT document, section, l_quantity AS quantity, l_tax AS tax, (l_shipdate, l_linenumber, l_partkey, l_extendedprice, l_returnflag, l_quantity) AS ord, l_linenumber AS line,
  CASE WHEN l_quantity < 6 THEN 'reopen' WHEN l_returnflag = 'A' THEN 'complete' WHEN l_returnflag = 'R' THEN 'mark_stale' ELSE 'edit' END AS kind FROM lineitem JOIN o ON l_orderkey = section),
f AS (SELECT document, section, coalesce(arg_max(kind = 'complete', ord) FILTER (kind IN ('complete', 'reopen')), false) AS completed,
  coalesce(arg_max(kind = 'mark_stale', ord) FILTER (kind <> 'edit'), false) AS stale, count(*) FILTER (kind = 'edit') AS n_edits FROM l GROUP BY 1, 2)
"""


@query(LOG_SQL + "SELECT * FROM f")
def section_facts(spark: SparkSession, folder: str) -> DataFrame:
    return S.facts(S.folded(_log(spark, folder), BY, "kind", ORDER), BY)


@query(LOG_SQL + """, w AS (SELECT document, section, bool_or(quantity > 49) AS blocks, bool_or(quantity > 49 OR tax > 0.07) AS fails, bool_or(tax = 0) AS asks FROM l GROUP BY 1, 2),
s AS (SELECT o.document, o.section, CASE WHEN o.before IS NOT NULL AND NOT coalesce(b.completed, false) THEN [o.before] ELSE [] END AS blocked_by, coalesce(w.blocks, false) AS blocks, coalesce(w.fails, false) AS fails, coalesce(w.asks, false) AS asks,
  w.section IS NOT NULL AS has, coalesce(f.completed, false) AS completed, coalesce(f.stale, false) AS stale
  FROM o LEFT JOIN f USING (document, section) LEFT JOIN f b ON b.document = o.document AND b.section = o.before LEFT JOIN w ON w.document = o.document AND w.section = o.section),
t AS (SELECT *, CASE WHEN stale THEN 'stale' WHEN completed AND NOT blocks THEN 'complete' WHEN len(blocked_by) > 0 THEN 'blocked' WHEN NOT has THEN 'empty' WHEN asks OR blocks THEN 'needs_input' ELSE 'drafted' END AS status FROM s)
SELECT document, section, status, blocked_by, CASE WHEN asks THEN ['tax'] ELSE [] END AS missing, list_concat(CASE WHEN blocks THEN ['quantity'] ELSE [] END, CASE WHEN fails THEN ['size or tax'] ELSE [] END) AS failures,
  CASE WHEN blocks THEN ['quantity'] ELSE [] END AS blockers, len(blocked_by) = 0 AND NOT asks AS can_draft, NOT blocks AND status NOT IN ('blocked', 'empty') AS can_complete FROM t
""")
def section_states(spark: SparkSession, folder: str) -> DataFrame:
    """Status, what it waits for, what is missing or fails, and what may be done, of every section."""
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "section").join(_orders(spark, folder), "section")
    known = S.facts(S.folded(_log(spark, folder), BY, "kind", ORDER), BY)
    answers = lines.select(*BY, F.lit("tax").alias("question"), F.when(F.col("l_tax") > 0, "said").otherwise(" ").alias("value"), F.lit("user").alias("source"))
    asked = answers.where("value = ' '").select(*BY, "question", F.lit(True).alias("required"))
    missing = S.missing_answers(asked, answers.where("value = ' '"), BY)
    large = lines.select(*BY, F.lit("quantity").alias("requirement"), F.lit("blocker").alias("severity"), F.when(F.col("l_quantity") > 49, "fail").otherwise("pass").alias("outcome"))
    other = lines.select(*BY, F.lit("size or tax").alias("requirement"), F.lit("warning").alias("severity"), F.when((F.col("l_quantity") > 49) | (F.col("l_tax") > 0.07), "error").otherwise("pass").alias("outcome"))
    return S.section_states(_orders(spark, folder), _needs(spark, folder), known, lines.select(*BY), missing, large.unionByName(other))


@query(LOG_SQL + """, e AS (SELECT document, section, ord, kind, last_value(CASE kind WHEN 'complete' THEN true WHEN 'reopen' THEN false END IGNORE NULLS) OVER (PARTITION BY document, section ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM l),
d AS (SELECT document, section, (SELECT coalesce(list(o.section ORDER BY o.section), []) FROM o WHERE o.document = e.document AND o.section > e.section) AS dependents FROM e WHERE kind = 'edit' AND was)
SELECT document, section, dependents, count(*) AS n FROM d GROUP BY ALL
""")
def edits_told(spark: SparkSession, folder: str) -> DataFrame:
    """Edits of complete sections, counted, with all that rests on each."""
    below = graph.reachable(_needs(spark, folder).select("section", "depends_on"), "section", "depends_on").select(F.col("section").alias("source"), F.col("depends_on").alias("target"), F.col("section").alias("position"))
    below = below.join(_orders(spark, folder).withColumnRenamed("section", "target"), "target")
    told = S.told_of_edits(_log(spark, folder), below, BY, "kind", ORDER)
    return told.groupBy("document", "section", "dependents").agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT o_custkey AS document, o_orderkey AS id, lag(o_orderkey) OVER w AS before, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
n AS (SELECT l_orderkey AS id, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
SELECT document, CASE WHEN id = first THEN 'first' ELSE 'o' || id END AS section, CASE WHEN before = first THEN 'first' WHEN before IS NOT NULL THEN 'o' || before ELSE '' END AS depends_on,
  CASE WHEN before = first THEN coalesce(n, 0) ELSE 0 END AS to_first FROM o LEFT JOIN n USING (id) WHERE id <> last OR first = last
""")
def rewritten_specs(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as specifications: the first section is renamed, the last deleted, and what names them follows."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("section"), F.concat(F.lit("l"), "l_linenumber").alias("key")).distinct()
    orders = _orders(spark, folder).join(_needs(spark, folder).select("section", "depends_on"), "section", "left")
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    block = F.struct("key", F.lit("prose").alias("kind"), F.array().cast("array<struct<key:string>>").alias("columns"))
    asked = F.struct(F.col("key").alias("id"), F.col("key").alias("block"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("array<string>").alias("fields"), F.concat(name("depends_on"), F.lit(".l1.x")).alias("references"))
    has = lambda what: F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), what)))
    by_section = orders.join(lines, "section", "left").groupBy("document", "section", "depends_on").agg(F.collect_list(F.when(F.col("key").isNotNull(), block)).alias("blocks"), has(asked).alias("requirements"))
    section = F.struct(name("section").alias("key"), F.array_compact(F.array(name("depends_on"))).alias("depends_on"), "blocks", "requirements")
    whole = by_section.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("section", section.alias("s")))).alias("all"))
    specs = whole.select("document", F.transform("all", lambda x: x["s"]).alias("sections"), F.array().cast("array<struct<id:string,scope:array<string>>>").alias("criteria"))
    ends = _orders(spark, folder).groupBy("document").agg(F.min("section").alias("first"), F.max("section").alias("last"))
    first = ends.select("document", F.lit(0).alias("seq"), F.array(name("first")).alias("path"), F.lit("first").alias("new"))
    last = ends.where("first <> last").select("document", F.lit(1).alias("seq"), F.array(name("last")).alias("path"), F.lit(None).cast("string").alias("new"))
    # Outer, as Spark would filter by the array that it explodes and work it out for each test.
    done = W.rewritten(specs, first.unionByName(last), "document").select("document", F.explode_outer("sections").alias("s")).where("s is not null")
    to_first = F.size(F.filter("s.requirements", lambda r: F.startswith(r["references"], F.lit("first."))))
    return done.select("document", F.col("s.key").alias("section"), F.array_join("s.depends_on", ",").alias("depends_on"), to_first.cast("long").alias("to_first"))
