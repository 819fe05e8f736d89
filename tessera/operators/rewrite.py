"""Renaming and deleting in nested specifications, with everything that names what was changed.

A specification is one row: ``sections``, an array of structs with key,
depends_on, blocks (key, kind, columns with key) and requirements (id, block, field,
fields, references), and ``criteria`` with id and scope. Changes of one
specification are made one after the other, each to what the one before left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIES = 20


def _with(value: Column, do: Callable[[Column], Column]) -> Column:
    """``do`` of a value that is worked out once, however often ``do`` names it."""
    return F.get(F.transform(F.array(value), do), F.lit(0))


def _each(items: Column, at: Column, do: Callable[[Column], Column]) -> Column:
    """``items`` with ``do`` applied to those whose key is ``at``."""
    return F.transform(items, lambda x: F.when(x["key"] == at, do(x)).otherwise(x))


def _free(new: Column, old: Column, items: Column) -> Column:
    """``new``, or with a number behind it where another of ``items`` has it."""
    tries = F.concat(F.array(new), F.transform(F.sequence(F.lit(2), F.lit(TRIES)), lambda n: F.concat_ws("_", new, n.cast("string"))))
    return _with(F.filter(F.transform(items, lambda x: x["key"]), lambda k: k != old), lambda taken: F.get(F.filter(tries, lambda k: ~F.array_contains(taken, k)), F.lit(0)))


def _named(items: Column, old: Column, new: Column) -> Column:
    """An array of keys with one renamed, or left out where ``new`` is null."""
    return F.filter(F.transform(items, lambda k: F.when(k == old, new).otherwise(k)), lambda k: k.isNotNull())


def _keys(items: Column, old: Column, new: Column) -> Column:
    """An array of structs with one's key renamed, or without it where ``new`` is null."""
    kept = F.filter(items, lambda x: new.isNotNull() | (x["key"] != old))
    return F.transform(kept, lambda x: F.when(x["key"] == old, x.withField("key", new)).otherwise(x))


def _references(sections: Column, path: Column, depth: int, new: Column) -> Column:
    """Sections whose references of three parts follow a renamed part; a deleted one leaves them as they are."""

    def moved(reference: Column) -> Column:
        def of(parts: Column) -> Column:
            same = F.lit(True)
            for i in range(depth):
                same = same & (F.get(parts, F.lit(i)) == F.get(path, F.lit(i)))
            out = F.concat_ws(".", *[new if i == depth - 1 else F.get(parts, F.lit(i)) for i in range(3)])
            return F.when(new.isNotNull() & (F.size(parts) == 3) & same, out).otherwise(reference)

        return _with(F.split(reference, r"\."), of)

    return F.transform(sections, lambda s: s.withField("requirements", F.transform(s["requirements"], lambda r: r.withField("references", moved(r["references"])))))


def _there(state: Column, path: Column, depth: int) -> Column:
    """Whether the specification has what a path names."""
    key = lambda i: F.get(path, F.lit(i))
    column = lambda b: F.exists(b["columns"], lambda c: c["key"] == key(2))
    block = lambda s: F.exists(s["blocks"], lambda b: (b["key"] == key(1)) & (column(b) if depth > 2 else F.lit(True)))
    return F.coalesce(F.exists(state["sections"], lambda s: (s["key"] == key(0)) & (block(s) if depth > 1 else F.lit(True))), F.lit(False))


def _of_section(state: Column, path: Column, new: Column) -> Column:
    old = F.get(path, F.lit(0))

    def named(new: Column) -> Column:
        sections = F.transform(_keys(state["sections"], old, new), lambda s: s.withField("depends_on", _named(s["depends_on"], old, new)))
        criteria = F.transform(state["criteria"], lambda c: c.withField("scope", _named(c["scope"], old, new)))
        return F.struct(_references(sections, path, 1, new).alias("sections"), criteria.alias("criteria"))

    return _with(F.when(new.isNotNull(), _free(new, old, state["sections"])), named)


def _of_block(state: Column, path: Column, new: Column) -> Column:
    at, old = F.get(path, F.lit(0)), F.get(path, F.lit(1))
    own = F.get(F.filter(state["sections"], lambda s: s["key"] == at), F.lit(0))

    def named(new: Column) -> Column:
        def section(s: Column) -> Column:
            kept = F.filter(s["requirements"], lambda r: new.isNotNull() | ~F.coalesce(r["block"] == old, F.lit(False)))
            asked = F.transform(kept, lambda r: F.when(r["block"] == old, r.withField("block", new)).otherwise(r))
            return s.withField("blocks", _keys(s["blocks"], old, new)).withField("requirements", asked)

        return F.struct(_references(_each(state["sections"], at, section), path, 2, new).alias("sections"), state["criteria"].alias("criteria"))

    return _with(F.when(new.isNotNull(), _free(new, old, own["blocks"])), named)


def _of_column(state: Column, path: Column, new: Column) -> Column:
    at, block, old = (F.get(path, F.lit(i)) for i in range(3))
    own = F.get(F.filter(F.get(F.filter(state["sections"], lambda s: s["key"] == at), F.lit(0))["blocks"], lambda b: b["key"] == block), F.lit(0))

    def named(new: Column) -> Column:
        def requirement(r: Column) -> Column:
            told = r.withField("field", F.when(r["field"] == old, new).otherwise(r["field"])).withField("fields", _named(r["fields"], old, new))
            return F.when(r["block"] == block, told).otherwise(r)

        def section(s: Column) -> Column:
            blocks = _each(s["blocks"], block, lambda b: b.withField("columns", _keys(b["columns"], old, new)))
            return s.withField("blocks", blocks).withField("requirements", F.transform(s["requirements"], requirement))

        return F.struct(_references(_each(state["sections"], at, section), path, 3, new).alias("sections"), state["criteria"].alias("criteria"))

    return _with(F.when(new.isNotNull(), _free(new, old, own["columns"])), named)


def rewritten(specs: DataFrame, changes: DataFrame, key: str = "spec") -> DataFrame:
    """``specs`` after ``changes``: ``key``, seq, path (one to three keys) and new, null to delete.

    A rename to a key that a sibling has gets a number behind it. Renames are
    followed in dependencies, scopes, requirements and references ``a.b.c``. A
    deleted section leaves dependencies and scopes, a deleted block takes its
    requirements with it, a deleted column leaves the fields of requirements;
    references to what is gone stay, for the lint to show. Changes of what is
    not there change nothing.
    """
    asked = changes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "path", "new"))).alias("_changes"))
    kind = f"struct<sections:{specs.schema['sections'].dataType.simpleString()},criteria:{specs.schema['criteria'].dataType.simpleString()}>"
    none = F.array().cast(asked.schema["_changes"].dataType)

    def step(state: Column, change: Column) -> Column:
        path, new = change["path"], change["new"]
        by_depth = [(1, _of_section), (2, _of_block), (3, _of_column)]
        made = F.coalesce(*[F.when((F.size(path) == n) & _there(state, path, n), do(state, path, new).cast(kind)) for n, do in by_depth])
        return F.coalesce(made, state)

    rows = specs.join(asked, key, "left")
    done = F.aggregate(F.coalesce("_changes", none), F.struct("sections", "criteria").cast(kind), step)
    rows = rows.withColumn("_done", done)
    return rows.select(*[F.col(f"_done.{c}").alias(c) if c in ("sections", "criteria") else F.col(c) for c in specs.columns])
