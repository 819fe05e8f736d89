"""Documents as Markdown, text and JSON, and checks of templates against types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(c: Column) -> Column:
    """A table cell: bars escaped, lines joined, a dash for nothing."""
    text = F.replace(F.regexp_replace(c, r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))
    return F.when(F.coalesce(F.btrim(c), F.lit("")) == "", "—").otherwise(F.when(c == "true", "yes").when(c == "false", "no").otherwise(text))


def markdown_table(columns: Column, rows: Column) -> Column:
    """Rows (maps) under their column names; nothing without rows."""
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = F.array(bar(columns), bar(F.transform(columns, lambda c: F.lit("---"))))
    body = F.transform(rows, lambda r: bar(F.transform(columns, lambda c: cell(F.try_element_at(r, c)))))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(head, body), "\n")).otherwise("")


def markdown_block(kind: Column, prose: Column, items: Column, fields: Column, rows: Column, columns: Column) -> Column:
    """A block in Markdown by its kind; empty where it has nothing to show."""
    listed = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    pairs = F.array_join(F.transform(columns, lambda c: F.concat(F.lit("- **"), c, F.lit(":** "), cell(F.try_element_at(fields, c)))), "\n")
    shown = F.when(kind == "prose", F.btrim(prose)).when(kind == "list", listed).when(kind == "keyvalue", pairs).when(kind == "table", markdown_table(columns, rows))
    return F.coalesce(shown, F.lit(""))


def markdown(blocks: DataFrame, document: str = "document") -> DataFrame:
    """``document`` and its Markdown.

    ``blocks`` has section, section_no, title, block_no, name and body. Sections
    with nothing to show are left out; a block named like its section, when it is
    the only one, has no heading of its own.
    """
    some = blocks.where("body <> ''")
    parts = F.array_sort(F.collect_list(F.struct("block_no", "name", "body")))
    sections = some.groupBy(document, "section_no", "title").agg(parts.alias("parts"))
    plain = (F.size("parts") == 1) & (F.col("parts")[0]["name"] == F.col("title"))
    each = F.transform("parts", lambda p: F.when(plain, p["body"]).otherwise(F.concat(F.lit("### "), p["name"], F.lit("\n\n"), p["body"])))
    text = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.array_join(each, "\n\n"))
    whole = F.array_sort(F.collect_list(F.struct(F.col("section_no").alias("n"), text.alias("t"))))
    return sections.groupBy(document).agg(F.array_join(F.transform(whole, lambda x: x["t"]), "\n\n").alias("markdown"))


def as_json(blocks: DataFrame, document: str = "document") -> DataFrame:
    """``document`` and a JSON object of its sections and blocks in order."""
    parts = F.array_sort(F.collect_list(F.struct("block_no", "name", "body")))
    sections = blocks.groupBy(document, "section_no", "title").agg(F.transform(parts, lambda p: F.struct(p["name"].alias("name"), p["body"].alias("value"))).alias("blocks"))
    every = F.array_sort(F.collect_list(F.struct(F.col("section_no").alias("n"), F.col("title").alias("title"), F.col("blocks").alias("blocks"))))
    body = F.transform(every, lambda s: F.struct(s["title"].alias("title"), s["blocks"].alias("blocks")))
    return sections.groupBy(document).agg(F.to_json(F.struct(body.alias("sections"))).alias("json"))


def template_problems(templates: DataFrame, declared: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, problem (unknown or missing) and tag: tags ``{{ section.block }}`` against what is declared."""
    tags = templates.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\{\{\s*([a-z0-9_]+(?:\.[a-z0-9_]+)*)\s*\}\}"), F.lit(1)))).alias("tag"))
    unknown = tags.join(declared.select("tag"), "tag", "left_anti").select(key, F.lit("unknown").alias("problem"), "tag")
    wanted = templates.select(key).join(F.broadcast(declared.select("tag")), how="cross")  # the blocks of one type, a few dozen
    missing = wanted.join(tags, [key, "tag"], "left_anti").select(key, F.lit("missing").alias("problem"), "tag")
    return unknown.unionByName(missing)


# The parts of what a writer is told about a section, in order.
CONTEXT_PARTS = ("overview", "targets", "answers", "passages", "upstream")


def writing_context(lines: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and context: the parts of a section's context in order, each under its name, blank lines left out.

    ``lines`` has part (one of CONTEXT_PARTS, others are left out), position and
    line. What one section is told is a page or two.
    """
    place = F.array_position(F.array(*[F.lit(p) for p in CONTEXT_PARTS]), F.col("part"))
    told = lines.where((place > 0) & (F.btrim(F.coalesce("line", F.lit(""))) != "")).withColumn("_place", place)
    rows = F.array_sort(F.collect_list(F.struct("position", "line")))
    parts = told.groupBy(*by, "_place", "part").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("_body"))
    whole = F.array_sort(F.collect_list(F.struct("_place", F.concat("part", F.lit(":\n"), "_body").alias("t"))))
    return parts.groupBy(*by).agg(F.array_join(F.transform(whole, lambda p: p["t"]), "\n\n").alias("context"))
