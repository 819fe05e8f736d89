"""The event log as a stream: windowed counts with late events, repeats, and the decisions in force."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_counts(events: DataFrame, at: str, category: str, *, length: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by category and window; events later than ``late`` are left out."""
    windows = events.withWatermark(at, late).groupBy(F.window(at, length, slide), category).agg(F.count("*").alias("n"))
    return windows.select(F.col("window.start").alias("begin"), F.col("window.end").alias("end"), category, "n")


def first_seen(sources: DataFrame, at: str, key: str, *, within: str = "7 days") -> DataFrame:
    """Each content once while its repeats come within the time given."""
    return sources.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


DECISION = "question string, key string, status string"


def decisions(stream: DataFrame) -> DataFrame:
    """The decision in force for each single-answer question: ``question``, ``key``, ``status``.

    A decision that was taken later wins whatever the order of arrival; state is
    one row for each question.
    """

    def update(question: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for batch in batches:
            for at, key, status in zip(batch["decided_at"], batch["key"], batch["status"], strict=True):
                new = (at.isoformat(), key, status)
                if best is None or new[:2] >= tuple(best[:2]):
                    best = new
        if best is not None:
            state.update(best)
            yield pd.DataFrame({"question": [question[0]], "key": [best[1]], "status": [best[2]]})

    return stream.groupBy("question").applyInPandasWithState(update, DECISION, "at string, key string, status string", "update", GroupStateTimeout.NoTimeout)
