"""Document types as tables: lint, references, slugs made unique, versions, descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeated(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The second row of every key that occurs more than once: a repetition is reported once."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("_nth", nth).where("_nth = 2").drop("_nth")


def twice(rows: DataFrame, by: list[str]) -> DataFrame:
    """Every key that occurs more than once, once: counted before the shuffle, so no order is needed where only the key is told."""
    return rows.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")


def unknown(refs: DataFrame, declared: DataFrame, ref: list[str], key: list[str]) -> DataFrame:
    """References to what is not declared."""
    names = declared.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)]).distinct()
    same = [F.col(r) == F.col(f"_key{i}") for i, r in enumerate(ref)]
    return refs.join(names, same, "left_anti")


def lint(sections: DataFrame, blocks: DataFrame, edges: DataFrame, requirements: DataFrame, longest: int = 100) -> DataFrame:
    """Problems of one or more types: ``spec``, ``rule``, ``subject``.

    Tables: sections(spec, section, position), blocks(spec, section, block,
    position), edges(spec, section, depends_on), requirements(spec, id, section,
    block, position).
    """
    from tessera.operators.graph import cyclic

    say = lambda df, rule, subject: df.select("spec", F.lit(rule).alias("rule"), subject.alias("subject"))
    here = F.concat_ws(".", "section", "block")
    inner = F.concat_ws("/", "spec", "section").alias("_s"), F.concat_ws("/", "spec", "depends_on").alias("_t")
    loops = cyclic(edges.where("section <> depends_on").select(*inner), "_s", "_t").select(F.split("node", "/", 2)[0].alias("spec"), F.split("node", "/", 2)[1].alias("section"))
    found = [
        say(sections.where(F.char_length("section") > longest), "key too long", F.col("section")),
        say(twice(sections, ["spec", "section"]), "section twice", F.col("section")),
        say(twice(blocks, ["spec", "section", "block"]), "block twice", here),
        say(unknown(sections, blocks, ["spec", "section"], ["spec", "section"]).dropDuplicates(["spec", "section"]), "section without blocks", F.col("section")),
        say(edges.where("section = depends_on"), "depends on itself", F.col("section")),
        say(unknown(edges, sections, ["spec", "depends_on"], ["spec", "section"]), "unknown dependency", F.concat_ws(" -> ", "section", "depends_on")),
        say(loops, "cycle", F.col("section")),
        say(twice(requirements, ["spec", "id"]), "requirement twice", F.col("id")),
        say(unknown(requirements, blocks, ["spec", "section", "block"], ["spec", "section", "block"]), "unknown block", F.concat_ws(": ", F.col("id"), here)),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


RULE_KINDS = ("present", "length", "rows", "fields_filled", "format", "cross_ref")


def lint_references(sections: DataFrame, columns: DataFrame, questions: DataFrame, requirements: DataFrame, criteria: DataFrame, scopes: DataFrame, longest: int = 100) -> DataFrame:
    """More problems of types, in what lies below blocks and in criteria: ``spec``, ``rule``, ``subject``.

    Tables: sections(spec, section), columns(spec, section, block, column,
    position), questions(spec, section, question, position), requirements(spec,
    id, section, block, field, references, position), criteria(spec, id, kind,
    position), scopes(spec, id, section). A repetition is told once, at its second
    place; what a requirement names must be a column of its own block,
    what it refers to one of any block, ``section.block.column``.
    """
    say = lambda df, rule, subject: df.select("spec", F.lit(rule).alias("rule"), subject.alias("subject"))
    place = F.concat_ws(".", "section", "block", "column")
    targets = columns.select("spec", place.alias("target"))
    ids = requirements.select("spec", "id").unionByName(criteria.select("spec", "id"))
    long = lambda df, key: say(df.where(F.char_length(key) > longest).select("spec", key).distinct(), "key too long", F.substring(key, 1, 40))
    found = [
        say(twice(columns, ["spec", "section", "block", "column"]), "column twice", place),
        say(twice(questions, ["spec", "section", "question"]), "question twice", F.concat_ws(".", "section", "question")),
        say(twice(ids, ["spec", "id"]), "id twice", F.col("id")),
        say(unknown(requirements.where("field is not null"), columns, ["spec", "section", "block", "field"], ["spec", "section", "block", "column"]), "unknown field", F.concat_ws(": ", "id", "field")),
        say(unknown(requirements.where("references is not null"), targets, ["spec", "references"], ["spec", "target"]), "unknown reference", F.concat_ws(": ", "id", "references")),
        say(unknown(scopes, sections, ["spec", "section"], ["spec", "section"]), "unknown scope", F.concat_ws(": ", "id", "section")),
        say(criteria.where(F.col("kind").isin(*RULE_KINDS)), "a rule and no criterion", F.col("id")),
        long(columns, "column"),
        long(questions, "question"),
        long(ids, "id"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def renamed(refs: DataFrame, old: Column, new: Column, *columns: str) -> DataFrame:
    """References with one key renamed."""
    return refs.withColumns({c: F.when(F.col(c) == old, new).otherwise(F.col(c)) for c in columns})


def renamed_path(path: Column, old: str, new: str) -> Column:
    """A dotted path whose first step is renamed."""
    return F.when(path == old, F.lit(new)).when(F.startswith(path, F.lit(old + ".")), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1_000_000))).otherwise(path)


def unique_slugs(rows: DataFrame, slug: str, by: list[str], order: str) -> DataFrame:
    """Equal slugs get ``_2``, ``_3`` and so on in order."""
    nth = F.row_number().over(Window.partitionBy(*by, slug).orderBy(order))
    return rows.withColumn("_nth", nth).withColumn(slug, F.when(F.col("_nth") > 1, F.concat(F.col(slug), F.lit("_"), F.col("_nth").cast("string"))).otherwise(F.col(slug))).drop("_nth")


def published(versions: DataFrame, new: DataFrame, by: str, version: str) -> DataFrame:
    """Versions with the new ones that clash with none; what was published does not change."""
    return versions.unionByName(new.join(versions.select(by, version), [by, version], "left_anti").select(*versions.columns))


def template_in_force(versions: DataFrame, by: str, version: str, template: str) -> DataFrame:
    """Every version with the last template that it or one before it brought."""
    over = Window.partitionBy(by).orderBy(version).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return versions.withColumn(template, F.last(template, ignorenulls=True).over(over))


def sentence(kind: Column, place: Column, params: Column) -> Column:
    """A requirement in words."""
    p = lambda name: F.try_element_at(params, F.lit(name))
    bounds = F.concat_ws(" and ", F.concat(F.lit("at least "), p("min")), F.concat(F.lit("at most "), p("max")))
    return (
        F.when(kind == "present", F.concat(place, F.lit(" must not be empty")))
        .when(kind == "length", F.concat(place, F.lit(" must have "), bounds, F.lit(" words")))
        .when(kind == "rows", F.concat(place, F.lit(" must have "), bounds, F.lit(" rows")))
        .when(kind == "fields_filled", F.concat(F.lit("every row of "), place, F.lit(" must fill "), p("fields")))
        .when(kind == "format", F.concat(p("field"), F.lit(" in "), place, F.lit(" must be a "), p("as")))
        .when(kind == "cross_ref", F.concat(p("field"), F.lit(" in "), place, F.lit(" must occur in "), p("target")))
        .otherwise(F.concat(place, F.lit(": "), kind))
    )


def under(problems: DataFrame, path: str, prefix: list[str]) -> DataFrame:
    """Problems at or below a structural path."""
    return problems.where(F.slice(F.col(path), 1, len(prefix)) == F.array(*[F.lit(x) for x in prefix]))


def layered_style(*levels: Column) -> Column:
    """Styles from the general to the special, those without text left out."""
    return F.concat_ws("\n\n", *[F.when(F.btrim(x) != "", F.btrim(x)) for x in levels])


def cross_ref_targets(columns: DataFrame) -> DataFrame:
    """``section.block.column`` of every column of a table block."""
    return columns.where("kind = 'table'").select(F.concat_ws(".", "section", "block", "column").alias("target"))


# The kinds of blocks and columns, and which rules can be asked of which kind of block.
BLOCK_KINDS = ("prose", "list", "keyvalue", "table")
COLUMN_KINDS = ("text", "number", "date", "enum", "boolean")
OFFERED = {"prose": ("present", "length"), "list": ("present",), "keyvalue": ("present",), "table": ("present", "rows", "fields_filled", "format", "cross_ref")}


def refs(elements: DataFrame, by: list[str], section_no: str, kind: str, order: list[Column]) -> DataFrame:
    """Adds ``ref``: ``S3`` for a section, ``S3-Q2`` and ``S3-C1`` for its questions and criteria, counted in order.

    ``elements`` has a row for each element with its section's place from 1; the
    elements of one section are few.
    """
    nth = F.row_number().over(Window.partitionBy(*by, section_no, kind).orderBy(*order)).cast("string")
    section = F.concat(F.lit("S"), F.col(section_no).cast("string"))
    letter = F.when(F.col(kind) == "question", "Q").when(F.col(kind) == "criterion", "C")
    return elements.withColumn("ref", F.when(letter.isNull(), section).otherwise(F.concat(section, F.lit("-"), letter, nth)))


def object_problems(objects: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and problem of blocks and columns that cannot be as they are.

    ``objects`` has level (block, column or question), kind, options (array) and
    columns (how many a block has).
    """
    options = F.coalesce(F.size("options"), F.lit(0))
    tests = [
        F.when((F.col("level") == "block") & ~F.col("kind").isin(*BLOCK_KINDS), "unknown kind of block"),
        F.when((F.col("level") == "column") & ~F.col("kind").isin(*COLUMN_KINDS), "unknown kind of column"),
        F.when((F.col("level") == "block") & F.col("kind").isin("table", "keyvalue") & (F.coalesce("columns", F.lit(0)) < 1), "no columns"),
        F.when((F.col("level") == "block") & F.col("kind").isin("prose", "list") & (F.coalesce("columns", F.lit(0)) > 0), "columns that it cannot have"),
        F.when((F.col("kind").isin("enum", "choice")) & (options < 2), "fewer than two options"),
        F.when(~F.col("kind").isin("enum", "choice") & (options > 0), "options that it cannot have"),
        F.when(F.size(F.array_distinct("options")) < F.size("options"), "an option twice"),
    ]
    return objects.select(*key, F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def with_required(blocks: DataFrame, requirements: DataFrame, by: list[str]) -> DataFrame:
    """Blocks whose flag ``required`` says whether a rule asks them to be present."""
    asked = requirements.where("kind = 'present'").select(*by).distinct().withColumn("_asked", F.lit(True))
    return blocks.drop("required").join(asked, by, "left").withColumn("required", F.coalesce("_asked", F.lit(False))).drop("_asked")


def offered(kind: Column) -> Column:
    """The rules that can be asked of a kind of block; none of an unknown one."""
    none = F.array().cast("array<string>")
    known = F.create_map(*[x for k, rules in OFFERED.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in rules]))])
    return F.coalesce(known[kind], none)


def walk(steps: DataFrame, by: list[str], order: list[Column], step: str) -> DataFrame:
    """Steps with their number, the one before and the one after in the order in which a type is walked through."""
    over = Window.partitionBy(*by).orderBy(*order)  # the steps of one type, a few dozen
    return steps.withColumns({"step_no": F.row_number().over(over), "before": F.lag(step).over(over), "after": F.lead(step).over(over)})


def form_of(path: Column) -> Column:
    """The form where a problem at ``section[.block[.column]]`` is mended."""
    depth = F.size(F.split(path, r"\."))
    return F.when(F.coalesce(path, F.lit("")) == "", "type").when(depth == 1, "section").when(depth == 2, "block").otherwise("column")
