"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors are one vector with a number of copies. Each table gives a vector
the signs of its products with some random directions; vectors with the same
signs meet in a bucket, where all cosines are computed in double precision. A
pair counts in the first table in which it meets, so links are counted once
without writing any pair. Buckets beyond a size are split into blocks, and each
two blocks meet in a task of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.workspace import keep

BUCKET = 512
BLOCK = 512
MISSED = 1e-3
SEED = 71
LISTED = 50_000


def tables_for(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a signature and number of tables, for about ``BUCKET`` vectors in a bucket.

    A pair with exactly the threshold's cosine is missed with a probability of
    ``MISSED`` at most, a closer one with less.
    """
    bits = max(1, round(math.log2(max(2.0, n / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log1p(-agree))


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    cuts = np.cumsum([0, *(len(x) for x in column)])
    return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def signatures(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """Appends each vector's bucket in every table; the directions depend on the dimension alone."""
    for batch in batches:
        vectors = _vectors(batch.column(2))
        codes = np.zeros((len(batch), tables), np.int64)
        dims = np.array([len(v) for v in vectors])
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            directions = np.random.default_rng([SEED, int(d)]).standard_normal((d, tables * bits))
            signs = (np.stack([vectors[r] for r in rows]) @ directions > 0).reshape(len(rows), tables, bits)
            codes[rows] = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * tables, pa.int32()), pa.array(codes.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "codes"])


def _linked(cell: pa.Table, threshold: float) -> pa.Table:
    """Per vector of a cell: the links that count here, and the smallest vector they reach."""
    table, split = cell.column("t")[0].as_py(), cell.column("j")[0].as_py() != cell.column("i")[0].as_py()
    ids = cell.column("rep").to_numpy()
    copies = cell.column("copies").to_numpy()
    block = cell.column("block").to_numpy()
    x = np.stack(_vectors(cell.column("v").combine_chunks()))
    codes = np.stack(cell.column("codes").combine_chunks().to_numpy(zero_copy_only=False))
    norms = np.sqrt((x * x).sum(axis=1))
    a, b = np.nonzero((x @ x.T) / (norms[:, None] * norms[None, :]) >= threshold)
    right = a < b
    if split:
        right &= block[a] != block[b]
    a, b = a[right], b[right]
    first = ~(codes[a, :table] == codes[b, :table]).any(axis=1)
    a, b = a[first], b[first]
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    root, before = ids.copy(), None
    while before is None or (before != root).any():
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
    some = links > 0
    return pa.table({"rep": ids[some], "links": links[some], "root": root[some]})


def near_vectors(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """``key``, n_links, component_id and kept of every row.

    Two rows link when their vectors have one dimension and a cosine of at least
    ``threshold``. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing. ``key`` is an integer; rows that repeat a key
    are one vertex of the graph but count as vectors of their own. A row with a
    null key has no links, no component and is not kept. Other columns, clashing
    names among them, are left out. An empty table gives no rows.
    """
    rows = rows.select(F.col(key).alias("row_key"), F.col(vector).alias("v"))
    usable = _usable(F.col("v")) & F.col("row_key").isNotNull()
    reps = rows.where(usable).groupBy("v").agg(F.min("row_key").alias("rep"), F.count("*").alias("copies"))
    reps = keep(reps.select("rep", "copies", "v"), "vectors")
    bits, tables = tables_for(reps.count(), threshold)
    v_type = dict(reps.dtypes)["v"]
    schema = f"rep long, copies long, v {v_type}, codes array<long>"
    signed = reps.select(F.col("rep").cast("long"), "copies", "v").mapInArrow(lambda it: signatures(it, bits, tables), schema)
    signed = keep(signed, "signatures")
    meetings = signed.select("*", F.posexplode("codes").alias("t", "code"), F.size("v").alias("dim"))
    bucket = ["t", "code", "dim"]
    large = meetings.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK)
    large = keep(large.select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large-buckets")
    if large.limit(LISTED + 1).count() <= LISTED:
        large = F.broadcast(large)
    placed = meetings.join(large, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    met = cells.groupBy(*bucket, "i", "j").applyInArrow(lambda cell: _linked(cell, threshold), "rep long, links long, root long")
    met = keep(met, "links")
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(met, "rep", "root").select(F.col("vertex").alias("rep"), F.col("component"))
    of_rep = reps.join(links, "rep", "left").join(labels, "rep", "left")
    of_rep = of_rep.select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    joined = rows.withColumn("v", F.when(usable, F.col("v"))).join(of_rep, "v", "left")
    component = F.coalesce("component", "row_key").cast("long")
    return joined.select(
        F.col("row_key").alias(key),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("row_key"), F.lit(False)).alias("kept"),
    )
