"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.workspace import drop_kept, keep

HELD = 1 << 20


def _jumped(hooks: DataFrame) -> DataFrame:
    """Hooks that point to the end of their chain, which each round brings twice as near."""
    while True:
        ahead = hooks.select(F.col("vertex").alias("to"), F.col("to").alias("beyond"))
        moved = keep(hooks.join(ahead, "to", "left").select("vertex", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "hooks")
        going = moved.where("moved").limit(1).count()
        drop_kept(hooks)
        hooks = moved.select("vertex", "to")
        if not going:
            return hooks


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of numbers, HELD at a time, as fewer ones that connect the same: each vertex with the least that it reaches."""
    kept, total = [], 0

    def stars() -> pa.RecordBatch:
        ends, place = np.unique(np.concatenate(kept), return_inverse=True)
        a, b = place[0::2], place[1::2]
        root, before = np.arange(len(ends)), None
        while before is None or (before != root).any():
            before = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a].copy(), low)
            np.minimum.at(root, root[b].copy(), low)
            root = root[root]
        some = np.flatnonzero(root != np.arange(len(ends)))
        return pa.RecordBatch.from_arrays([pa.array(ends[some]), pa.array(ends[root[some]])], ["high", "low"])

    for batch in batches:
        if len(batch):
            kept.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1).ravel())
            total += len(batch)
        if total > HELD:
            yield stars()
            kept, total = [], 0
    if kept:
        yield stars()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``vertex`` and ``component``, the smallest vertex reachable, of every vertex that has an edge.

    Every vertex hooks onto its smallest smaller neighbour, chains of hooks are
    shortened by jumping, and the edges between what then differs are
    contracted; each round at least halves the vertices that have edges. Loops,
    repeated edges and edges with a null end are left out. Edges of numbers are
    first made fewer within their tasks.
    """
    pairs = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    pairs = pairs.select(F.greatest(left, right).alias("high"), F.least(left, right).alias("low"))
    if dict(pairs.dtypes)["high"] == "bigint":
        pairs = pairs.mapInArrow(_forest, "high long, low long")
    pairs = keep(pairs.distinct(), "edges")
    found = pairs.select(F.col("high").alias("vertex")).union(pairs.select("low")).distinct()
    found = keep(found.withColumn("component", F.col("vertex")), "components")
    while pairs.limit(1).count():
        hooks = _jumped(keep(pairs.groupBy(F.col("high").alias("vertex")).agg(F.min("low").alias("to")), "hooks"))
        of_high = hooks.select(F.col("vertex").alias("high"), F.col("to").alias("high_to"))
        of_low = hooks.select(F.col("vertex").alias("low"), F.col("to").alias("low_to"))
        a, b = F.coalesce("high_to", "high"), F.coalesce("low_to", "low")
        joined = pairs.join(of_high, "high", "left").join(of_low, "low", "left").where(a != b)
        contracted = keep(joined.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "edges")
        hooked = hooks.select(F.col("vertex").alias("component"), "to")
        renamed = keep(found.join(hooked, "component", "left").select("vertex", F.coalesce("to", "component").alias("component")), "components")
        for old in (pairs, found, hooks):
            drop_kept(old)
        pairs, found = contracted, renamed
    return found
