"""Orders over declared dependencies: topological order, dependents, cycles, trees.

Edges are a DataFrame. Every pass is one join and the frontier is deduplicated
before the next, so a path is never expanded twice to the same node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpointed

DIGITS = 20


def reachable(edges: DataFrame, source: str, target: str) -> DataFrame:
    """All pairs ``(source, target)`` with a way from one to the other, each once.

    Ways are doubled: after k passes all pairs of up to 2**k edges are known, and a
    longer one begins with a way of just 2**k edges, so only these are led on;
    along a chain every pair is met once. It ends when no pair is new.
    """
    exact = known = checkpointed(edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(source, target).distinct())

    def led_on(onward: DataFrame) -> DataFrame:
        onward = onward.select(F.col(source).alias("_mid"), F.col(target).alias("_end"))
        return exact.join(onward, F.col(target) == F.col("_mid")).select(source, F.col("_end").alias(target)).distinct()

    while True:
        fresh = checkpointed(led_on(known).join(known, [source, target], "left_anti"))
        if fresh.isEmpty():
            return known
        exact = checkpointed(led_on(exact))
        known = known.unionByName(fresh)


def dependents(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Everything that rests on a node, directly or not: ``(source, target)`` where source depends on target."""
    return reachable(edges, source, target)


def cyclic(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Nodes that depend on themselves."""
    return reachable(edges, source, target).where(F.col(source) == F.col(target)).select(F.col(source).alias("node")).distinct()


def topological(nodes: DataFrame, edges: DataFrame, key: str, position: str, source: str, target: str) -> DataFrame:
    """Nodes with their layer: 0 without dependencies, else one more than the deepest of them.

    A node's layer is the longest way below it. Nodes on a cycle, and those that
    rest on one, get a null layer.
    """
    layers = nodes.select(key, position, F.lit(0).alias("layer"))
    size = nodes.count()
    bad = cyclic(edges, source, target)
    for _ in range(size):
        below = edges.join(layers.select(F.col(key).alias(target), F.col("layer").alias("_below")), target)
        deeper = below.groupBy(F.col(source).alias(key)).agg((F.max("_below") + 1).alias("_layer"))
        moved = checkpointed(layers.join(deeper, key, "left").select(key, position, F.greatest("layer", F.coalesce("_layer", F.lit(0))).alias("layer")))
        changed = moved.join(layers.withColumnRenamed("layer", "_old"), [key, position]).where(F.col("layer") != F.col("_old")).limit(1).count()
        layers = moved
        if not changed or moved.agg(F.max("layer")).first()[0] > size:
            break
    tainted = reachable(edges, source, target).join(bad.select(F.col("node").alias(target)), target).select(F.col(source).alias(key)).union(bad).distinct()
    tainted = tainted.withColumn("_bad", F.lit(True))
    return layers.join(tainted, key, "left").select(key, position, F.when(F.col("_bad").isNull(), F.col("layer")).alias("layer"))


def candidates(nodes: DataFrame, edges: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """Pairs ``(source, target)`` that may be added to the declared edges of a specification without a cycle.

    The nodes are the sections of one specification, a few dozen, so all their
    pairs are a small table by nature; they are paired by their specification.
    """
    ends = nodes.select(F.col(key).alias(source), F.lit(1).alias("_spec"))
    pairs = ends.join(ends.withColumnRenamed(source, target), "_spec").where(F.col(source) != F.col(target)).drop("_spec")
    back = reachable(edges, source, target).select(F.col(source).alias("_t"), F.col(target).alias("_s"))
    there = edges.select(F.col(source).alias("_s"), F.col(target).alias("_t"))
    return pairs.join(back.unionByName(there).distinct(), (F.col("_s") == F.col(source)) & (F.col("_t") == F.col(target)), "left_anti")


def descended(nodes: DataFrame, key: str, parent: str, order: str) -> DataFrame:
    """Nodes in pre-order with their depth; ``place`` sorts a node behind its parent, orphans last with a null depth.

    Every pass joins the ways above to those below, so they double in length;
    when a pass brings no node to its root, those that are left have none.
    """
    number = F.lpad(F.col(order).cast("string"), DIGITS, "0")
    name = F.concat(number, F.lit(":"), F.col(key).cast("string"))
    ways = checkpointed(nodes.select("*", F.col(parent).alias("_top"), F.array(name).alias("place")))
    left, before = ways.where("_top is not null").count(), None
    while left and left != before:
        up = ways.select(F.col(key).alias("_key"), F.col("_top").alias("_beyond"), F.col("place").alias("_above"))
        joined = ways.join(up, F.col("_top") == F.col("_key"), "left")
        known = F.col("_key").isNotNull()
        top, place = F.when(known, F.col("_beyond")).otherwise(F.col("_top")), F.when(known, F.concat("_above", "place")).otherwise(F.col("place"))
        ways = checkpointed(joined.select(*nodes.columns, top.alias("_top"), place.alias("place")))
        before, left = left, ways.where("_top is not null").count()
    orphan = F.col("_top").isNotNull()
    depth = F.when(~orphan, F.size("place") - 1)
    return ways.select(*nodes.columns, depth.alias("depth"), F.when(orphan, F.array(F.lit("~"), name)).otherwise(F.col("place")).alias("place"))
