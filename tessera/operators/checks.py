"""Rule checks over block content, and what becomes of their results.

Content is a DataFrame with a row for each block: ``section``, ``block``,
``kind`` and the value in the column of its kind: ``prose`` (string), ``items``
(array of string), ``fields`` (map) or ``rows`` (array of map). A requirement is
a row with its parameters as columns. Results have ``requirement``, ``outcome``
(pass, fail, not_applicable or error), ``reason`` and ``evidence``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V


def flattened(kind: Column, prose: Column, items: Column, fields: Column, rows: Column) -> Column:
    """A block's text: its words whatever its kind."""
    cells = lambda m: F.filter(F.map_values(m), lambda v: v.isNotNull())
    return (
        F.when(kind == "prose", F.coalesce(prose, F.lit("")))
        .when(kind == "list", F.array_join(F.coalesce(items, F.array().cast("array<string>")), "\n"))
        .when(kind == "keyvalue", F.array_join(cells(fields), "\n"))
        .otherwise(F.array_join(F.transform(rows, lambda r: F.array_join(cells(r), " ")), "\n"))
    )


def is_blank(kind: Column, prose: Column, items: Column, fields: Column, rows: Column) -> Column:
    """Null, blank text or an empty collection; numbers and booleans are never blank."""
    empty = (
        F.when(kind == "prose", T.blank(prose)).when(kind == "list", F.size(items) <= 0).when(kind == "keyvalue", F.size(fields) <= 0).otherwise(F.size(rows) <= 0)
    )
    return F.coalesce(empty, F.lit(True))


def result(outcome: Column, reason: Column, evidence: Column | None = None) -> Column:
    return F.struct(outcome.alias("outcome"), reason.alias("reason"), (F.array().cast("array<string>") if evidence is None else evidence).alias("evidence"))


def present(blank: Column, kind: Column, fields: Column, required: Column) -> Column:
    """Fails when blank; a key-value block also when a required field is."""
    missing = F.filter(required, lambda f: T.blank(F.try_element_at(fields, f)))
    lacking = (kind == "keyvalue") & (F.size(missing) > 0)
    return F.when(blank, result(F.lit("fail"), F.lit("is empty"))).when(lacking, result(F.lit("fail"), F.concat(F.lit("missing: "), F.array_join(missing, ", ")))).otherwise(
        result(F.lit("pass"), F.lit(""))
    )


def length(text: Column, least_words: Column, most_words: Column, least_chars: Column, most_chars: Column) -> Column:
    """Words between white space and code points against bounds; every bound that is broken is named."""
    words, chars = T.word_count(text), F.char_length(text)
    broken = F.concat_ws(
        "; ",
        F.when(words < least_words, F.format_string("%d words, at least %d", words, least_words)),
        F.when(words > most_words, F.format_string("%d words, at most %d", words, most_words)),
        F.when(chars < least_chars, F.format_string("%d characters, at least %d", chars, least_chars)),
        F.when(chars > most_chars, F.format_string("%d characters, at most %d", chars, most_chars)),
    )
    return result(F.when(broken == "", "pass").otherwise("fail"), broken)


def row_count(kind: Column, n: Column, least: Column, most: Column) -> Column:
    """Rows of a table against bounds."""
    reason = F.when(n < least, F.format_string("%d rows, at least %d", n, least)).when(n > most, F.format_string("%d rows, at most %d", n, most))
    return F.when(kind != "table", result(F.lit("not_applicable"), F.lit("no table"))).otherwise(
        result(F.when(reason.isNull(), "pass").otherwise("fail"), F.coalesce(reason, F.lit("")))
    )


def blank_cells(rows: Column, fields: Column, place: Column) -> Column:
    """Paths ``place[i].field`` of blank cells of wanted fields, rows from 0."""
    of_row = lambda r, i: F.transform(F.filter(fields, lambda f: T.blank(F.try_element_at(r, f))), lambda f: F.concat(place, F.lit("["), i.cast("string"), F.lit("]."), f))
    return F.flatten(F.transform(rows, of_row))


def fields_filled(rows: Column, fields: Column, place: Column) -> Column:
    holes = blank_cells(rows, fields, place)
    return F.when(F.size(rows) <= 0, result(F.lit("not_applicable"), F.lit("no rows"))).otherwise(
        result(F.when(F.size(holes) == 0, "pass").otherwise("fail"), F.when(F.size(holes) > 0, F.format_string("%d cells are empty", F.size(holes))).otherwise(""), holes)
    )


def bad_cells(cells: DataFrame, kind: Column, options: Column, value: str = "value") -> DataFrame:
    """Cells that are no value of their column's kind; blank ones are passed over."""
    return cells.where(~T.blank(value) & ~V.parses_as(F.col(value), kind, options))


def dangling(cells: DataFrame, targets: DataFrame, value: str, target: str) -> DataFrame:
    """Cells whose value no target has; blank cells are passed over. Null targets match nothing."""
    there = targets.select(F.col(target).cast("string").alias("_target")).where("_target is not null").distinct()
    return cells.where(~T.blank(F.col(value).cast("string"))).join(there, F.col(value).cast("string") == F.col("_target"), "left_anti")


def mentions(points: DataFrame, answers: DataFrame, by: list[str], point: str, quote: str, source: str) -> DataFrame:
    """For each check: fails listing the points that no answer established with a quote from the text."""
    good = answers.where(F.col("established") & T.quoted_from(quote, source)).select(*by, point).distinct().withColumn("_ok", F.lit(True))
    joined = points.join(good, [*by, point], "left")
    lacking = F.array_sort(F.collect_list(F.when(F.col("_ok").isNull(), F.col(point))))
    return joined.groupBy(*by).agg(lacking.alias("missing")).withColumn("outcome", F.when(F.size("missing") == 0, "pass").otherwise("fail"))


def verdict(raw: Column, reachable: Column) -> Column:
    """A judge's word as an outcome: an unknown word fails, an outage is an error."""
    word = F.lower(F.btrim(raw))
    return F.when(~reachable, "error").when(word.isin("pass", "fail", "not_applicable"), word).otherwise("fail")


def blocks_export(severity: Column, outcome: Column) -> Column:
    return (severity == "blocker") & outcome.isin("fail", "error")


def evaluate(requirements: DataFrame, contents: DataFrame, by: list[str]) -> DataFrame:
    """Every requirement with its outcome, reason and evidence, by the rule of its kind.

    ``requirements`` has ``by`` (what names a block), kind and params (a map of
    text); ``contents`` has ``by``, block_kind, prose, items, fields and rows. A
    block that is not there is empty. Kinds that no rule here decides give an
    error, cross references among them, which :func:`dangling` compares.
    """
    joined = requirements.join(contents, by, "left")
    kind = F.coalesce("block_kind", F.lit("prose"))
    value = (kind, F.col("prose"), F.col("items"), F.col("fields"), F.col("rows"))
    rows = F.coalesce("rows", F.array().cast(contents.schema["rows"].dataType))
    param = lambda name: F.try_element_at("params", F.lit(name))
    number = lambda name, default: F.coalesce(param(name).try_cast("int"), F.lit(default))
    names = F.filter(F.split(F.coalesce(param("fields"), F.lit("")), ","), lambda x: x != "")
    options = F.split(F.coalesce(param("options"), F.lit("")), ",")
    cells = F.transform(rows, lambda r: F.try_element_at(r, param("field")))
    bad = F.filter(cells, lambda c: ~T.blank(c) & ~V.parses_as(c, param("as"), options))
    most = 2**31 - 1
    found = (
        F.when(F.col("kind") == "present", present(is_blank(*value), kind, F.col("fields"), names))
        .when(F.col("kind") == "length", length(F.coalesce(flattened(*value), F.lit("")), number("min_words", 0), number("max_words", most), number("min_chars", 0), number("max_chars", most)))
        .when(F.col("kind") == "rows", row_count(kind, F.size(rows), number("min", 0), number("max", most)))
        .when(F.col("kind") == "fields_filled", fields_filled(rows, names, F.lit("rows")))
        .when(F.col("kind") == "format", result(F.when(F.size(bad) == 0, "pass").otherwise("fail"), F.when(F.size(bad) > 0, F.format_string("%d cells are no %s", F.size(bad), param("as"))).otherwise(""), bad))
        .otherwise(result(F.lit("error"), F.concat(F.lit("no rule for "), F.coalesce("kind", F.lit("nothing")))))
    )
    return joined.select(*requirements.columns, found.alias("_found")).select(*requirements.columns, "_found.outcome", "_found.reason", "_found.evidence")


def scoped(criteria: DataFrame, contents: DataFrame, document: str = "document") -> DataFrame:
    """Judged criteria with the text that they are about, in order of sections.

    ``criteria`` has document, criterion and scope, an array of sections, or null
    for the whole document; ``contents`` has document, section, position and
    text. A criterion whose scope has no words is not put to a judge: its outcome
    is ``fail``; that of the others is null until they are judged.
    """
    whole = criteria.where(F.col("scope").isNull()).drop("scope")
    listed = criteria.where(F.col("scope").isNotNull()).select(document, "criterion", F.explode_outer(F.array_distinct("scope")).alias("section"))
    some = whole.join(contents, document, "left").unionByName(listed.join(contents, [document, "section"], "left"))
    said = F.when(~T.blank("text"), F.struct("position", "section", F.btrim("text").alias("text")))
    parts = F.array_sort(F.collect_list(said))
    text = some.groupBy(document, "criterion").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))
    return text.withColumn("outcome", F.when(F.col("text") == "", "fail"))
