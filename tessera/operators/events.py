"""The event log: counts, spend, rotation, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_since(events: DataFrame, hours: int, *, at: str = "at", category: str = "category", ok: str = "ok") -> DataFrame:
    """Counts by category and outcome over the last hours before the newest event."""
    newest = events.agg(F.max(at).alias("_newest"))
    recent = events.join(F.broadcast(newest), F.col(at) >= F.col("_newest") - F.make_interval(hours=F.lit(hours)))  # one row
    return recent.groupBy(category, ok).agg(F.count("*").alias("n"))


def spend(events: DataFrame, by: list[str | Column], *, ok: str = "ok", duration: str = "duration", tokens: Column) -> DataFrame:
    """Calls, failures, seconds and tokens in one pass; seconds in a decimal, so that sums do not depend on their order."""
    return events.groupBy(*by).agg(
        F.count("*").alias("calls"),
        F.count_if(~F.col(ok)).alias("failures"),
        F.sum(F.col(duration).cast("decimal(18,6)")).cast("double").alias("seconds"),
        F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"),
    )


def per_second(chunks: Column, duration_ms: Column) -> Column:
    return F.when(duration_ms > 0, F.bround(chunks / (duration_ms / 1000), 1))


def readable(kind: Column, names: dict[str, str]) -> Column:
    """A kind's declared name, else the kind itself with spaces and a capital."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    plain = F.replace(kind, F.lit("_"), F.lit(" "))
    fallback = F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1_000_000))
    return F.coalesce(table[kind], fallback) if names else fallback


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table."""
    found = None
    for name, df in tables.items():
        own = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        found = own if found is None else found.unionByName(own)
    return found
