"""Filing pasted passages into sections: parts, checked placements, digests, spans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.split import split_parts
from tessera.session import checkpointed

PART_CHARS, TOLERANCE, PARTS, MOST_PLACED = 12_000, 15, 20, 40
WIDTH = 1024
ROWS_A_TASK = 1 << 18


def parts(pastes: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The first parts of every paste, and per paste how many characters lie beyond them."""
    cut = split_parts(pastes, key, text, PART_CHARS, TOLERANCE)
    unread = cut.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("part_no") >= PARTS, F.char_length("part"))), F.lit(0)).alias("unread"))
    return cut.where(F.col("part_no") < PARTS), unread


def ceiling(n_sections: Column, chars: Column) -> Column:
    """How many placements a part may give."""
    most = F.least(F.greatest(5 * n_sections, F.floor(chars / 100)), F.lit(MOST_PLACED))
    return F.when(most < 1, 1).otherwise(most)


def checked(placements: DataFrame, sections: DataFrame, nowhere: str = "nowhere") -> DataFrame:
    """Adds ``state``: placed, unplaced (said to belong nowhere) or discarded (unknown section, quote not in the text)."""
    known = sections.select(F.col("section").alias("_s")).distinct().withColumn("_known", F.lit(True))
    told = placements.withColumn("_quoted", T.quoted_from("quote", "text"))  # before the join, so that texts go along only where they are asked for
    joined = told.join(known, F.col("section") == F.col("_s"), "left")
    good = F.coalesce("_known", F.lit(False)) & F.col("_quoted")
    return joined.withColumn("state", F.when(F.col("section") == nowhere, "unplaced").when(good, "placed").otherwise("discarded")).drop("_s", "_known", "_quoted")


def merged(placed: DataFrame, by: list[str]) -> DataFrame:
    """One placement for each section and quote, spaces and case aside; the first part's stays."""
    quote = T.folded(T.collapse("quote"))
    first = F.min_by(F.struct(*[c for c in placed.columns if c not in by]), F.struct("part_no", "ord"))
    rows = placed.groupBy(*by, quote.alias("_quote")).agg(first.alias("_row"))
    return rows.select(*by, "_row.*")


def part_confidence(placed: DataFrame, by: list[str]) -> DataFrame:
    """The mean over parts that gave any placement."""
    return placed.groupBy(*by, "part_no").agg(F.avg("confidence").alias("_c")).groupBy(*by).agg(F.round(F.avg("_c"), 6).alias("confidence"))


def section_context(placed: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """The first parts that a section's passages came from."""
    return placed.groupBy(*by).agg(F.slice(F.array_sort(F.collect_set("part_no")), 1, most).alias("part_nos"))


def prefilled(proposals: DataFrame, answers: DataFrame, by: list[str]) -> DataFrame:
    """Proposals that say something, are quoted, and do not overwrite what a person answered."""
    ok = proposals.where(F.col("found") & F.col("fits") & ~T.blank("value") & T.quoted_from("quote", "text"))
    return ok.join(answers.where("source = 'user'").select(*by).distinct(), by, "left_anti")


def quote_kept(old_value: Column, new_value: Column, old_quote: Column, new_quote: Column) -> Column:
    """An answer keeps its quote while its value does not change."""
    return F.when(old_value.eqNullSafe(new_value), F.coalesce(new_quote, old_quote)).otherwise(new_quote)


def _meeting(quotes: DataFrame, texts: DataFrame, by: list[str], quote: str, text: str) -> DataFrame:
    """``_q`` and ``_t`` of quotes and texts with the same ``by`` that may hold them.

    Quotes of three words or more meet the texts that have the longest word inside
    their first eight, shorter ones all of their ``by``; neither quotes nor texts
    are in what is joined.
    """
    words = F.split(T.folded(T.collapse(quote)), " ")
    inner = F.transform(F.slice(words, 2, F.least(F.size(words) - 2, F.lit(6))), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w")))
    asked = quotes.where(~T.blank(quote)).select("_q", *by, F.when(F.size(words) > 2, F.try_element_at(F.array_sort(inner), F.lit(-1))["w"]).alias("_word"))
    having = texts.select("_t", *by, F.explode(F.array_distinct(F.split(T.folded(T.collapse(text)), " "))).alias("_word"))
    found = asked.where("_word is not null").join(having, [*by, "_word"]).select("_q", "_t")
    short = asked.where("_word is null").join(texts.select("_t", *by), by).select("_q", "_t")
    return found.unionByName(short)


def claims(answers: DataFrame, pastes: DataFrame, case: str) -> DataFrame:
    """Each quoted answer with the newest paste of its case that has the quote; rows that repeat stay apart.

    Quotes and texts are numbered, and joined only to the pairs that may match.
    ``pastes`` has paste_id and pasted_at.
    """
    asked = checkpointed(answers.withColumn("_q", F.monotonically_increasing_id()))
    texts = checkpointed(pastes.select("paste_id", "pasted_at", case, F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_t")))
    pairs = _meeting(asked, texts, [case], "quote", "_text").join(asked.select("_q", F.col("quote").alias("_quote")), "_q").join(texts.drop(case), "_t")
    newest = pairs.where(T.quoted_from("_quote", "_text")).groupBy("_q").agg(F.max_by("paste_id", F.struct("pasted_at", "paste_id")).alias("paste_id"))
    return asked.join(newest, "_q").drop("_q")


def sections_filed(links: DataFrame, claimed: DataFrame, sections: DataFrame) -> DataFrame:
    """A paste's digest by section: paste_id, section, section_no, links, questions, confirmed.

    ``links`` has link_id, paste_id, section and created_at; ``claimed`` the answers
    that :func:`claims` gave a paste, with section, question, question_no and
    source; ``sections`` section and section_no. A section that none declares is
    the hundredth. Links are in the order in which they were made, questions in
    that of their section.
    """
    in_order = lambda order, what: F.transform(F.array_sort(F.collect_list(F.struct(*order, what))), lambda x: x[what])
    filed = links.groupBy("paste_id", "section").agg(in_order(["created_at"], "link_id").alias("links"))
    told = claimed.groupBy("paste_id", "section").agg(in_order(["question_no"], "question").alias("questions"), F.count_if(F.col("source") != "proposed").alias("confirmed"))
    rows = filed.join(told, ["paste_id", "section"], "full_outer").join(sections.select("section", "section_no"), "section", "left")
    none = lambda like: F.array().cast(dict(rows.dtypes)[like])
    return rows.select("paste_id", "section", F.coalesce("section_no", F.lit(100)).alias("section_no"), F.coalesce("links", none("links")).alias("links"), F.coalesce("questions", none("questions")).alias("questions"), F.coalesce("confirmed", F.lit(0)).alias("confirmed"))


def link_spans(links: DataFrame, pastes: DataFrame, sections: DataFrame) -> DataFrame:
    """paste_id, section_no, char_from, char_to: where each paste has what was filed from it."""
    rows = links.select("link_id", "paste_id", "section", "quote").join(pastes.select("paste_id", "text"), "paste_id")
    rows = rows.join(sections.select("section", "section_no"), "section", "left").withColumn("at", F.struct("paste_id", F.coalesce("section_no", F.lit(100)).alias("section_no"), "link_id"))
    found = quote_spans(rows, "at", "text", "quote").where("char_from is not null")
    return found.select("at.paste_id", "at.section_no", "char_from", "char_to")


def united(spans: DataFrame, by: list[str], begin: str = "char_from", end: str = "char_to", width: int = WIDTH) -> DataFrame:
    """``by``, ``begin``, ``end``: the stretches that any span covers, those that touch as one.

    A sweep over ordered starts, first within stretches of ``width`` characters,
    then over what is left, which is not more than a text has characters however
    many spans lie on it. Null and empty spans cover nothing. Spans are counted
    first and dealt to tasks of about ``ROWS_A_TASK``, so that what a task holds
    does not grow with them; repeats are dropped where they meet.
    """

    def swept(rows: DataFrame, within: list[str]) -> DataFrame:
        order = Window.partitionBy(*within).orderBy(begin, end)
        before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
        begun = rows.withColumn("_new", F.when(F.col(begin) <= before, 0).otherwise(1))
        runs = begun.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return runs.groupBy(*within, "_run").agg(F.min(begin).alias(begin), F.max(end).alias(end)).drop("_run")

    rows = spans.where(F.col(end) > F.col(begin)).select(*by, begin, end)
    tasks = max(1, -(-rows.count() // ROWS_A_TASK))
    dealt = lambda df, within: df.repartition(tasks, *within) if within else df
    near = dealt(rows.withColumn("_stretch", F.floor(F.col(begin) / width)), [*by, "_stretch"]).distinct()
    return swept(dealt(swept(near, [*by, "_stretch"]).drop("_stretch"), by), by)


def quote_spans(rows: DataFrame, key: str, text: str, quote: str) -> DataFrame:
    """``key``, char_from and char_to of the first place of a quote in a text, case, white space and ``>`` between words aside."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for batch in batches:
            found = []
            for body, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = [re.escape(w) for w in (said or "").split() if w != ">"]
                m = re.search(r"[\s>]+".join(words), body or "", re.IGNORECASE) if words else None
                found.append((m.start(), m.end()) if m else (None, None))
            begin, end = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["key", "char_from", "char_to"])

    return rows.select(key, text, quote).mapInArrow(run, f"`{key}` {kind}, char_from int, char_to int")


def stale_pins(pins: DataFrame, current: DataFrame, block: str = "block") -> DataFrame:
    """Pins whose passage the block's text no longer has."""
    joined = pins.join(current.select(block, F.col("text").alias("_text")), block, "left")
    return joined.where(~T.quoted_from("passage", F.coalesce("_text", F.lit("")))).drop("_text")


def distinct_pins(pins: DataFrame, block: str = "block") -> DataFrame:
    """Pins without repeats, spaces and case aside; the first stays."""
    nth = F.row_number().over(Window.partitionBy(block, T.folded(T.collapse("passage"))).orderBy("pinned_at", "pin_id"))
    return pins.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def filed_here(passages: DataFrame, answers: DataFrame, by: list[str], passage: str = "text") -> DataFrame:
    """Passages of a section with the questions whose answers are quoted from them, in order; none gives an empty list.

    Passages that repeat stay apart. Rows are numbered, so that texts are joined
    only to the pairs that may match.
    """
    rows = checkpointed(passages.withColumn("_t", F.monotonically_increasing_id()))
    asked = checkpointed(answers.select(*by, "question", "quote", F.monotonically_increasing_id().alias("_q")))
    pairs = _meeting(asked, rows, by, "quote", passage).join(asked.drop(*by), "_q").join(rows.select("_t", F.col(passage).alias("_text")), "_t")
    held = pairs.where(T.quoted_from("quote", "_text")).groupBy("_t").agg(F.array_sort(F.collect_set("question")).alias("questions"))
    kind = held.schema["questions"].dataType
    return rows.join(held, "_t", "left").withColumn("questions", F.coalesce("questions", F.array().cast(kind))).drop("_t")
