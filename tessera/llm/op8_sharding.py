"""Sharding by minimax contiguous partition, with DataFrame functions only.

Rows are laid out in the order of a 64-bit hash of their text, so that equal
texts are neighbours and form one atomic group. Over that order the smallest
shard capacity is searched for which a greedy walk needs no more than the wanted
number of shards, and the walk's cuts at that capacity are the shards.

The walk needs group sizes only where a cut can fall. The driver therefore
starts from the sums of at most 2**14 hash ranges and asks Spark for finer sums
just of the ranges that some cut may fall into, until those ranges are single
groups. What the driver holds is bounded by constants, whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.workspace import keep

FIRST_BITS = 14
NODES_A_ROUND = 1 << 16
CELL_ROWS = 512


@dataclass(frozen=True)
class Node:
    """A range of the hash order: those places whose first ``bits`` bits are ``prefix``."""

    prefix: int
    bits: int
    bytes: int
    groups: int
    largest: int

    @property
    def first_place(self) -> int:
        return self.prefix << (64 - self.bits)


def _prefix(bits: int) -> Column:
    return F.shiftright("place", 64 - bits) if bits < 64 else F.col("place")


def _nodes(groups: DataFrame, bits: int) -> list[Node]:
    rows = (
        groups.groupBy(_prefix(bits).alias("prefix"))
        .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"), F.max("bytes").alias("largest"))
        .collect()
    )
    return [Node(r.prefix, bits, r.bytes, r.groups, r.largest) for r in rows]


def walk(sizes: list[int], capacity: int) -> list[int]:
    """Where shards begin when each takes items in order while they fit."""
    starts, load = [0], 0
    for i, size in enumerate(sizes):
        if load + size > capacity and load:
            starts.append(i)
            load = 0
        load += size
    return starts


def smallest_capacity(sizes: list[int], n_shards: int, low: int, high: int) -> int:
    """The least capacity from ``low`` to ``high`` for which the walk needs at most ``n_shards``."""
    while low < high:
        middle = (low + high) // 2
        if len(walk(sizes, middle)) <= n_shards:
            high = middle
        else:
            low = middle + 1
    return low


def _uncertain(nodes: list[Node], n_shards: int, low: int, high: int) -> list[Node]:
    """Nodes of several groups that a cut can fall into at some capacity from ``low`` to ``high``.

    With whole nodes and the low capacity no cut is reached earlier, with
    divisible nodes and the high one none is reached later.
    """
    ends, total = [], 0
    for node in nodes:
        total += node.bytes
        ends.append(total)
    starts = walk([n.bytes for n in nodes], low)
    earliest = [ends[i - 1] for i in starts[1:n_shards]]
    spans = [(first, min(total, (i + 1) * high)) for i, first in enumerate(earliest)]
    found, k = [], 0
    for node, end in zip(nodes, ends, strict=True):
        while k < len(spans) and spans[k][1] <= end - node.bytes:
            k += 1
        if node.groups > 1 and any(a < end and b > end - node.bytes for a, b in spans[k:]):
            found.append(node)
    return found


def boundaries(groups: DataFrame, n_shards: int) -> list[int]:
    """The first place of each shard but the first, by exact minimax over ``groups(place, bytes)``."""
    nodes = sorted(_nodes(groups, FIRST_BITS), key=lambda n: n.first_place)
    while nodes:
        sizes = [n.bytes for n in nodes]
        total = sum(sizes)
        low = max(-(-total // n_shards), max(n.largest for n in nodes))
        high = smallest_capacity(sizes, n_shards, low, total)
        coarse = _uncertain(nodes, n_shards, low, high)
        if not coarse:
            capacity = smallest_capacity(sizes, n_shards, low, high)
            return [nodes[i].first_place for i in walk(sizes, capacity)[1:]]
        finer = []
        step = max(1, (NODES_A_ROUND // len(coarse)).bit_length() - 1)
        for bits in sorted({n.bits for n in coarse}):
            inside = groups.where(_prefix(bits).isin([n.prefix for n in coarse if n.bits == bits]))
            finer += _nodes(inside, min(64, bits + step))
        gone = set(coarse)
        nodes = sorted([n for n in nodes if n not in gone] + finer, key=lambda n: n.first_place)
    return []


def shard(docs: DataFrame, n_shards: int = 40, *, text: str = "text", key: str = "doc_id", overhead: int = 16) -> DataFrame:
    """One row per row of ``docs``: ``key``, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus ``overhead``; the largest shard is as
    small as contiguous shards in hash order allow. Rows with equal texts share
    a shard. A null text counts as no bytes and its checksum is 0; null texts
    are not equal to each other, each row is a group by its key. Repeated rows
    and null keys keep a row and a slot each. An empty table gives no rows.
    Slots run from 0 without gaps in each shard; hot groups are numbered in
    parts, dealt by a number that each row is written with, so no task ever
    holds a whole group, however often key and text repeat.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = keep(
        docs.select(
            F.col(key).alias("row_key"),
            (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.when(F.col(text).isNull(), F.xxhash64(F.lit("no text"), F.col(key))).otherwise(F.xxhash64(text)).alias("place"),
            F.monotonically_increasing_id().alias("salt"),
        ),
        "shard-rows",
    )
    groups = keep(rows.groupBy("place").agg(F.sum("size").alias("bytes")), "shard-groups")
    cuts = boundaries(groups, n_shards)
    number = F.lit(0)
    if cuts:
        number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("place")))
    rows = rows.withColumns({"shard": number.cast("int"), "block": _prefix(FIRST_BITS)})
    blocks = rows.groupBy("block").agg(F.ceil(F.count("*") / CELL_ROWS).alias("parts"))  # at most 2**FIRST_BITS rows
    rows = rows.join(F.broadcast(blocks), "block").withColumn("part", F.pmod(F.xxhash64("salt", F.lit(1)), "parts"))
    cell = ["shard", "block", "part"]
    cells = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block", "part")) - F.col("n")
    cells = cells.select(*cell, before.alias("before"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("place", "row_key", "salt"))
    return rows.join(cells, cell).select(
        F.col("row_key").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + inside - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
