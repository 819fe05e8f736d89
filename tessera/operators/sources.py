"""Sources of a case: repeats, removal, attachments, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_SIDE, MOST_ASPECT = 80, 12


def with_repeats(sources: DataFrame, by: list[str], content: str, order: list[Column]) -> DataFrame:
    """Adds digest and status: the first source with a content is queued, later ones are repeats.

    The first is found by an aggregate and joined back, so a content that a third
    of all sources share is never sorted in one task.
    """
    tagged = sources.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256)).withColumn("_order", F.struct(*order))
    first = tagged.groupBy(*by, "digest").agg(F.min("_order").alias("_first"))
    joined = tagged.join(first, [*by, "digest"], "left")
    return joined.withColumn("status", F.when(F.col("_order").eqNullSafe(F.col("_first")), "queued").otherwise("repeat")).drop("_order", "_first")


def without(sources: DataFrame, removed: DataFrame, key: str, by: list[str], content: str, order: list[Column]) -> DataFrame:
    """Sources less the removed ones; the oldest repeat of a removed content takes its place."""
    return with_repeats(sources.join(removed, key, "left_anti"), by, content, order)


def inherited(children: DataFrame, parents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Attachments with what their mail says of itself where they say nothing."""
    above = parents.select(F.col(key).alias("parent_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = children.join(above, "parent_id", "left")
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).select(*children.columns)


def image_report(images: DataFrame, case: str = "case") -> DataFrame:
    """Per case: images kept, repeated, too small or of an odd shape, unreadable."""
    nth = F.row_number().over(Window.partitionBy(case, "sha256").orderBy("image_id"))
    wide, high = F.greatest("width", "height"), F.least("width", "height")
    state = (
        F.when(F.col("width").isNull() | F.col("height").isNull(), "unreadable")
        .when(nth > 1, "repeated")
        .when((high < LEAST_SIDE) | (wide / high > MOST_ASPECT), "too_small")
        .otherwise("kept")
    )
    states = images.withColumn("_state", state)
    return states.groupBy(case).agg(*[F.count_if(F.col("_state") == s).alias(s) for s in ("kept", "repeated", "too_small", "unreadable")])


def asset_label(label: Column, caption: Column) -> tuple[Column, Column]:
    """What an image is called, and its label unless that says no more than the caption."""
    return F.coalesce(label, caption), F.nullif(label, caption)


def caption_batches(images: DataFrame, by: str, order: str, size: int = 4) -> DataFrame:
    """Numbers of the batches in which images are captioned."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return images.withColumn("batch", F.floor((nth - 1) / size))
