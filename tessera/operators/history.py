"""Append-only history: latest rows, sequence numbers, upserts, rotation, cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each group in the given ascending order, by an aggregate that combines before the shuffle."""
    others = [c for c in rows.columns if c not in by]
    last = rows.groupBy(*by).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return last.select(*by, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*rows.columns)


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "seq", start: int = 1) -> DataFrame:
    """Gapless numbers within each group."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + (start - 1)).cast("long"))


def appended(old: DataFrame, new: DataFrame, by: Sequence[str], order: Sequence[Column], seq: str = "seq") -> DataFrame:
    """``old`` and, behind the largest number of their group, the rows of ``new`` in order."""
    top = old.groupBy(*by).agg(F.max(seq).alias("_top"))
    fresh = numbered(new, by, order, seq).join(top, list(by), "left")
    fresh = fresh.withColumn(seq, F.col(seq) + F.coalesce("_top", F.lit(0))).drop("_top")
    return old.unionByName(fresh.select(*old.columns))


def upserted(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every key once: the new row where there is one, else the old."""
    others = [c for c in old.columns if c not in by]
    a = old.select(*by, F.struct(*others).alias("_old"))
    b = new.select(*by, F.struct(*[F.col(c) for c in others]).alias("_new"))
    both = a.join(b, list(by), "full")
    row = F.coalesce("_new", "_old")
    return both.select(*by, *[row[c].alias(c) for c in others]).select(*old.columns)


def kept_newest(rows: DataFrame, at: str, n: int) -> DataFrame:
    """The newest ``n`` rows and all that tie with the last of them; none for ``n`` of 0 or less.

    The cutoff comes from a top-n, which each task takes for itself first, so the
    log is neither sorted nor sent to one task.
    """
    if n <= 0:
        return rows.limit(0)
    cutoff = rows.select(at).orderBy(F.col(at).desc_nulls_last()).limit(n).agg(F.min(at).alias("_cutoff"), F.count("*").alias("_n"))
    return rows.join(F.broadcast(cutoff), (F.col(at) >= F.col("_cutoff")) | (F.col("_n") < n) | F.col("_cutoff").isNull(), "left_semi")  # one row


def newest_per(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def cascaded(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is still there."""
    return rows.join(parents.select(F.col(parent_key).alias("_parent")).distinct(), F.col(key) == F.col("_parent"), "left_semi")


def detached(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """All rows; the reference to a parent that is gone is null."""
    there = parents.select(F.col(parent_key).alias("_parent")).distinct()
    joined = rows.join(there, F.col(key) == F.col("_parent"), "left")
    return joined.withColumn(key, F.col("_parent")).select(*rows.columns)


def with_counts(parents: DataFrame, children: DataFrame, key: str, counts: dict[str, Column]) -> DataFrame:
    """Parents with counts of their children, 0 for none; the children are counted before the join."""
    own = children.groupBy(key).agg(*[c.cast("long").alias(n) for n, c in counts.items()])
    return parents.join(own, key, "left").fillna(0, list(counts))


def states(log: DataFrame, by: Sequence[str], order: Sequence[Column], status: str) -> DataFrame:
    """The last status of every item of an event log, and how many events it had."""
    return log.groupBy(*by).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("n_events"))


def superseded(log: DataFrame, by: Sequence[str], order: Sequence[Column], status: str, pending: str = "pending") -> DataFrame:
    """Pending proposals that a later one of the same group follows become ``superseded``."""
    later = F.lead(F.lit(1)).over(Window.partitionBy(*by).orderBy(*order)).isNotNull()
    return log.withColumn(status, F.when((F.col(status) == pending) & later, "superseded").otherwise(F.col(status)))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down; 0 of nothing."""
    return F.when(whole > 0, F.floor(100 * part / whole)).otherwise(0).cast("long")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key`` and whether it was created or dropped between two listings."""
    made = after.select(key).distinct().join(before.select(key).distinct(), key, "left_anti").withColumn("change", F.lit("created"))
    gone = before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti").withColumn("change", F.lit("dropped"))
    return made.unionByName(gone)


def tree_order(nodes: DataFrame, key: str, parent: str, order: str) -> DataFrame:
    """Nodes before their children, siblings in order; nodes without a way to a root come last."""
    from tessera.operators.graph import descended

    return descended(nodes, key, parent, order)


def edited(drafts: DataFrame, edits: DataFrame, by: list[str], columns: list[str], token: str = "token") -> DataFrame:
    """Drafts after edits that were made to the version they say: ``columns`` and the token change, and ``state`` tells what happened.

    One row for each draft. Of edits with the draft's token one is made, the first
    by its values; all others are conflicts and change nothing: see
    :func:`conflicts`. Drafts without an edit are ``kept``, edited ones
    ``changed``, those with conflicts alone ``conflict``.
    """
    values = F.struct(*[F.col(c).alias(f"_{c}") for c in columns])
    asked = edits.groupBy(*by, F.col(token).alias("_token")).agg(F.min(values).alias("_edit"))
    any_edit = edits.select(*by).distinct().withColumn("_asked", F.lit(True))
    joined = drafts.join(any_edit, by, "left").join(asked.withColumnRenamed("_token", token).withColumn("_ok", F.lit(True)), [*by, token], "left")
    ok = F.coalesce("_ok", F.lit(False))
    state = F.when(ok, "changed").when(F.col("_asked"), "conflict").otherwise("kept")
    changed = {c: F.when(ok, F.col(f"_edit._{c}")).otherwise(F.col(c)) for c in columns} | {token: F.when(ok, F.col(token) + 1).otherwise(F.col(token))}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in drafts.columns], state.alias("state"))


def conflicts(drafts: DataFrame, edits: DataFrame, by: list[str], columns: list[str], token: str = "token") -> DataFrame:
    """Edits that were not made: their token is not the draft's, or another edit with it was made."""
    values = F.struct(*columns)
    made = edits.join(drafts.select(*by, token), [*by, token], "left_semi").groupBy(*by, token).agg(F.min(values).alias("_made"))
    rows = edits.join(made, [*by, token], "left").withColumn("_same", F.coalesce(F.col("_made") == values, F.lit(False)))
    nth = F.row_number().over(Window.partitionBy(*by, token, "_same").orderBy(*columns))
    return rows.withColumn("_nth", nth).where(~F.col("_same") | (F.col("_nth") > 1)).select(*edits.columns)
