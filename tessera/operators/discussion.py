"""Threads of messages: the last turns, turns of one speaker joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_MESSAGES = 16


def history(messages: DataFrame, thread: str, order: str, *, most: int = MOST_MESSAGES, leading: str = "assistant") -> DataFrame:
    """Turns of the last messages of each thread: ``thread``, turn_no, role, n_messages, text.

    Messages of one role that follow each other are one turn, texts joined by a
    blank line. A first turn of ``leading`` is dropped, as it answers nothing
    that is shown. Only the last ``most`` messages of a thread are kept before
    anything is gathered.
    """
    newest = F.row_number().over(Window.partitionBy(thread).orderBy(F.col(order).desc()))
    last = messages.withColumn("_nth", newest).where(F.col("_nth") <= most).drop("_nth")
    along = Window.partitionBy(thread).orderBy(order)
    change = F.when(F.lag("role").over(along).eqNullSafe(F.col("role")), 0).otherwise(1)
    runs = last.withColumn("_change", change).withColumn("_run", F.sum("_change").over(along))
    texts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    turns = runs.groupBy(thread, "_run", "role").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(texts, lambda x: x["t"]), "\n\n").alias("text"))
    shown = turns.where((F.col("_run") > 1) | (F.col("role") != leading))
    return shown.select(thread, F.row_number().over(Window.partitionBy(thread).orderBy("_run")).alias("turn_no"), "role", "n_messages", "text")


def role_runs(messages: DataFrame, thread: str, order: str) -> DataFrame:
    """Runs of messages of one role over whole threads: ``thread``, first, last, role, n."""
    along = Window.partitionBy(thread).orderBy(order)
    island = F.row_number().over(along) - F.row_number().over(Window.partitionBy(thread, "role").orderBy(order))
    return messages.withColumn("_island", island).groupBy(thread, "role", "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_island")
