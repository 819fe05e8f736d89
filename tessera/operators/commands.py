"""Commands of questions: read leniently, described, and required for their kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

PATTERN_CHARS, ASK_CHARS, MOST_KEYWORDS = 200, 300, 24
COMMAND = "struct<kind:string,pattern:string,keywords:array<string>,ask:string>"


def _keywords(words: Column) -> Column:
    """Distinct keywords, spaces collapsed, case aside, the first ones."""
    plain = F.filter(F.transform(words, T.collapse), lambda w: F.coalesce(w != "", F.lit(False)))
    first = lambda w, i: F.array_position(F.transform(plain, T.folded), T.folded(w)) == i + 1
    return F.slice(F.filter(plain, first), 1, MOST_KEYWORDS)


def parsed(questions: DataFrame, key: str, raw: str) -> DataFrame:
    """``key``, command_no and the command of every usable entry of a JSON array; others are passed over."""
    entries = F.from_json(F.col(raw), f"array<{COMMAND}>", {"mode": "PERMISSIVE"})
    rows = questions.select(key, F.posexplode(entries).alias("command_no", "c")).select(key, "command_no", "c.*").withColumn("keywords", _keywords(F.col("keywords")))
    usable = (
        F.when(F.col("kind") == "pattern", ~T.blank("pattern") & (F.char_length("pattern") <= PATTERN_CHARS))
        .when(F.col("kind") == "keyword_ask", (F.size("keywords") > 0) & ~T.blank("ask") & (F.char_length("ask") <= ASK_CHARS))
        .when(F.col("kind") == "ask", ~T.blank("ask") & (F.char_length("ask") <= ASK_CHARS))
    )
    return rows.where(F.coalesce(usable, F.lit(False)))


def described(kind: Column, pattern: Column, keywords: Column, ask: Column) -> Column:
    """A command in words."""
    return (
        F.when(kind == "pattern", F.concat(F.lit("match "), pattern))
        .when(kind == "keyword_ask", F.concat(F.lit("passages with "), T.listed(keywords), F.lit(": "), ask))
        .otherwise(F.concat(F.lit("best passages: "), ask))
    )


def dumped(commands: DataFrame, key: str) -> DataFrame:
    """The commands of every question as a JSON array in order."""
    one = F.struct("command_no", F.struct("kind", "pattern", "keywords", "ask").alias("c"))
    every = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"])
    return commands.groupBy(key).agg(F.to_json(every).alias("commands"))
