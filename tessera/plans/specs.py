"""Queries over a small declared document type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import history as H
from tessera.operators import specs as S
from tessera.plans.query import query
from tessera.session import table

SECTIONS = [("s", "intro", 0), ("s", "facts", 1), ("s", "cause", 2), ("s", "actions", 3), ("s", "review", 4), ("s", "facts", 5), ("s", "loop_a", 6), ("s", "loop_b", 7), ("s", "after_loop", 8)]
EDGES = [
    ("s", "facts", "intro"), ("s", "cause", "facts"), ("s", "actions", "cause"), ("s", "actions", "intro"), ("s", "review", "actions"), ("s", "review", "gone"),
    ("s", "intro", "intro"), ("s", "loop_a", "loop_b"), ("s", "loop_b", "loop_a"), ("s", "after_loop", "loop_a"),
]
SECTIONS_SQL = "sections(spec, section, position) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in SECTIONS) + ")"
EDGES_SQL = "edges(spec, section, depends_on) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in EDGES) + ")"


def _sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SECTIONS, "spec string, section string, position int")


def _edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "spec string, section string, depends_on string")


@query(f"""
WITH RECURSIVE {EDGES_SQL}, r(section, depends_on) AS (SELECT section, depends_on FROM edges WHERE section <> depends_on
  UNION SELECT r.section, e.depends_on FROM r JOIN edges e ON r.depends_on = e.section WHERE e.section <> e.depends_on)
SELECT section, depends_on FROM r
""")
def transitive_dependents(spark: SparkSession, folder: str) -> DataFrame:
    return G.dependents(_edges(spark).where("section <> depends_on"), "section", "depends_on")


@query("""
SELECT section, position, layer FROM (VALUES ('intro', 0, 0), ('facts', 1, 1), ('cause', 2, 2), ('actions', 3, 3), ('review', 4, 4),
  ('loop_a', 6, NULL), ('loop_b', 7, NULL), ('after_loop', 8, NULL)) t(section, position, layer)
""")
def topo_order(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _sections(spark).where("position <> 5").select("section", "position")
    return G.topological(nodes, _edges(spark).where("section <> depends_on and depends_on <> 'gone'"), "section", "position", "section", "depends_on")


@query(f"""
WITH {SECTIONS_SQL} SELECT section, position FROM (SELECT *, row_number() OVER (PARTITION BY spec, section ORDER BY position) AS r FROM sections) WHERE r = 2
""")
def lint_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return S.repeated(_sections(spark), ["spec", "section"], "position").select("section", "position")


@query(f"""
WITH {SECTIONS_SQL}, {EDGES_SQL} SELECT section, depends_on FROM edges WHERE depends_on NOT IN (SELECT section FROM sections)
""")
def lint_unknown_refs(spark: SparkSession, folder: str) -> DataFrame:
    return S.unknown(_edges(spark), _sections(spark), ["spec", "depends_on"], ["spec", "section"]).select("section", "depends_on")


@query("""
SELECT * FROM (VALUES ('s', 'section twice', 'facts'), ('s', 'block twice', 'facts.table'), ('s', 'section without blocks', 'review'), ('s', 'depends on itself', 'intro'),
  ('s', 'unknown dependency', 'review -> gone'), ('s', 'cycle', 'loop_a'), ('s', 'cycle', 'loop_b'), ('s', 'requirement twice', 'r1'), ('s', 'unknown block', 'r2: cause.none')) t(spec, rule, subject)
""")
def spec_lint(spark: SparkSession, folder: str) -> DataFrame:
    blocks = [("s", x, "text", i) for i, x in enumerate(("intro", "facts", "cause", "actions", "loop_a", "loop_b", "after_loop"))] + [("s", "facts", "table", 7), ("s", "facts", "table", 8)]
    needs = [("s", "r1", "intro", "text", 0), ("s", "r1", "facts", "text", 1), ("s", "r2", "cause", "none", 2)]
    return S.lint(
        _sections(spark),
        spark.createDataFrame(blocks, "spec string, section string, block string, position int"),
        _edges(spark),
        spark.createDataFrame(needs, "spec string, id string, section string, block string, position int"),
    )


@query(f"""
WITH RECURSIVE {SECTIONS_SQL}, {EDGES_SQL}, n AS (SELECT DISTINCT section FROM sections), r(section, depends_on) AS (SELECT section, depends_on FROM edges WHERE section <> depends_on
  UNION SELECT r.section, e.depends_on FROM r JOIN edges e ON r.depends_on = e.section WHERE e.section <> e.depends_on)
SELECT a.section, b.section AS depends_on FROM n a JOIN n b ON a.section <> b.section
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.section = b.section AND r.depends_on = a.section) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.section = a.section AND e.depends_on = b.section)
""")
def dependency_candidates(spark: SparkSession, folder: str) -> DataFrame:
    edges = _edges(spark).where("section <> depends_on").select("section", "depends_on")
    return G.candidates(_sections(spark).select("section").distinct(), edges, "section", "section", "depends_on")


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS key, CAST(depth AS INTEGER) AS depth, CAST(row_number() OVER (ORDER BY root, depth, n_nationkey) AS BIGINT) AS place FROM (
  SELECT n_nationkey, 1 AS depth, n_regionkey AS root FROM nation UNION ALL SELECT r_regionkey + 1000, 0, r_regionkey FROM region)
""")
def tree_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, each before its nations."""
    from pyspark.sql import Window

    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    nodes = nation.select(F.col("n_nationkey").cast("long").alias("key"), (F.col("n_regionkey") + 1000).cast("long").alias("parent")).unionByName(
        region.select((F.col("r_regionkey") + 1000).cast("long").alias("key"), F.lit(None).cast("long").alias("parent"))
    )
    found = H.tree_order(nodes, "key", "parent", "key")
    return found.select("key", "depth", F.row_number().over(Window.orderBy("place")).cast("long").alias("place"))  # as many rows as a tree listing shows


@query("""
SELECT p_brand, p_size, last_value(t IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS template FROM (
  SELECT p_brand, p_size, max(CASE WHEN p_size % 7 = 0 THEN p_type END) AS t FROM part GROUP BY 1, 2)
""")
def template_in_force(spark: SparkSession, folder: str) -> DataFrame:
    versions = table(spark, folder, "part").groupBy("p_brand", "p_size").agg(F.max(F.when(F.col("p_size") % 7 == 0, F.col("p_type"))).alias("template"))
    return S.template_in_force(versions, "p_brand", "p_size", "template")


@query("""
SELECT n_nationkey, CASE WHEN r > 1 THEN s || '_' || r ELSE s END AS slug FROM (
  SELECT n_nationkey, s, row_number() OVER (PARTITION BY s ORDER BY n_nationkey) AS r FROM (SELECT n_nationkey, lower(substr(n_name, 1, 6)) AS s FROM nation))
""")
def unique_slugs(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.functions import text as T

    rows = table(spark, folder, "nation").withColumn("_s", F.lit(1)).select("n_nationkey", T.slug(F.substring("n_name", 1, 6)).alias("slug"))
    return S.unique_slugs(rows, "slug", [], "n_nationkey")


@query("""
WITH o AS (SELECT o_custkey AS spec, o_orderkey AS section, o_orderpriority AS p, o_orderstatus AS st FROM orders),
l AS (SELECT spec, section, l_returnflag AS block, 'c' || l_linenumber AS col, 'r' || l_partkey AS id, 'c' || CAST(l_quantity AS BIGINT) AS field, section || '.' || l_linestatus || '.c' || l_linenumber AS ref,
  row_number() OVER (PARTITION BY spec ORDER BY section, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS position FROM lineitem JOIN o ON l_orderkey = section),
c AS (SELECT spec, section, block, col, row_number() OVER (PARTITION BY spec, section, block, col ORDER BY position) AS nth FROM l),
ids AS (SELECT spec, id, 0 AS of, position FROM l UNION ALL SELECT spec, 'r' || section, 1, section FROM o),
k AS (SELECT DISTINCT spec, section || '.' || block || '.' || col AS target FROM l)
SELECT spec, rule, subject FROM (
  SELECT spec, 'column twice' AS rule, section || '.' || block || '.' || col AS subject FROM c WHERE nth = 2
  UNION ALL SELECT spec, 'id twice', id FROM (SELECT spec, id, row_number() OVER (PARTITION BY spec, id ORDER BY of, position) AS nth FROM ids) WHERE nth = 2
  UNION ALL SELECT spec, 'unknown field', id || ': ' || field FROM l WHERE NOT EXISTS (SELECT 1 FROM l m WHERE m.spec = l.spec AND m.section = l.section AND m.block = l.block AND m.col = l.field)
  UNION ALL SELECT spec, 'unknown reference', id || ': ' || ref FROM l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.spec = l.spec AND k.target = l.ref)
  UNION ALL SELECT spec, 'unknown scope', 'r' || section || ': ' || (section + 1) FROM o WHERE NOT EXISTS (SELECT 1 FROM o n WHERE n.spec = o.spec AND n.section = o.section + 1)
  UNION ALL SELECT spec, 'a rule and no criterion', 'r' || section FROM o WHERE st = 'F')
""")
def lint_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as types: orders are sections and criteria, lines are columns and requirements."""
    from pyspark.sql import Window

    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("spec"), F.col("o_orderkey").alias("section"), "o_orderpriority", "o_orderstatus")
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "section").join(orders, "section")
    nth = F.row_number().over(Window.partitionBy("spec").orderBy("section", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    text = lambda c: F.col(c).cast("string")
    column = F.concat(F.lit("c"), text("l_linenumber"))
    rows = lines.select(
        "spec", text("section").alias("section"), F.col("l_returnflag").alias("block"), column.alias("column"), F.concat(F.lit("r"), text("l_partkey")).alias("id"),
        F.concat(F.lit("c"), F.col("l_quantity").cast("long").cast("string")).alias("field"), F.concat_ws(".", text("section"), "l_linestatus", column).alias("references"), nth.cast("long").alias("position"),
    )
    name = F.concat(F.lit("r"), text("section"))
    kind = F.when(F.col("o_orderstatus") == "F", "present").otherwise("rubric")
    questions = orders.select("spec", text("section").alias("section"), F.col("o_orderpriority").alias("question"), F.col("section").alias("position"))
    criteria = orders.select("spec", name.alias("id"), kind.alias("kind"), F.col("section").cast("long").alias("position"))
    scopes = orders.select("spec", name.alias("id"), (F.col("section") + 1).cast("string").alias("section"))
    return S.lint_references(orders.select("spec", text("section").alias("section")), rows, questions, rows, criteria, scopes)
