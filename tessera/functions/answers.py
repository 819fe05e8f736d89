"""Answers that a model gave as JSON text: schemas, conformance, salvage, and what is kept of them.

No model is called here; its answers come as a column.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, MapType, StringType, StructField, StructType

from tessera.functions import text as T

MOST_BLANKS = 80


def block_schema(kind: str, columns: list[str] | None = None) -> StructType:
    """The schema of an answer that fills a block of a kind."""
    cells = StructType([StructField(c, StringType()) for c in columns or []])
    value: DataType = {"prose": StringType(), "list": ArrayType(StringType()), "keyvalue": cells, "table": ArrayType(cells), "image_ref": ArrayType(MapType(StringType(), StringType()))}[kind]
    return StructType([StructField("value", value)])


# Schemas of answers by what was asked.
PASSAGE_ANSWER = StructType([StructField("found", StringType()), StructField("value", StringType()), StructField("quote", StringType()), StructField("confidence", DoubleType())])
PLACEMENTS = StructType([StructField("assignments", ArrayType(StructType([StructField("section", StringType()), StructField("quote", StringType()), StructField("confidence", DoubleType())])))])
PROPOSED_TERMS = StructType([StructField("keywords", ArrayType(StringType()))])
CAPTIONS = StructType([StructField("captions", ArrayType(StructType([StructField("n", StringType()), StructField("caption", StringType())])))])


def conforming(raw: Column, schema: StructType, required: list[str], most: dict[str, int] | None = None) -> Column:
    """The answer as a struct: unknown fields dropped, long arrays cut; null where it is no object or lacks a field."""
    read = F.from_json(raw, schema, {"mode": "PERMISSIVE"})
    cut = F.struct(*[(F.slice(read[f.name], 1, most[f.name]) if f.name in (most or {}) else read[f.name]).alias(f.name) for f in schema.fields])
    whole = F.lit(True)
    for name in required:
        whole = whole & read[name].isNotNull()
    return F.when(read.isNotNull() & whole, cut)


@F.pandas_udf(StringType())
def salvaged(raw: pd.Series) -> pd.Series:
    """Text whose only fault is that its outer object was not closed, closed behind its last whole member; else null.

    Text that is a whole JSON object comes back as it is.
    """
    import json

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        depth, inside, escaped, last = 0, False, False, -1
        for i, c in enumerate(text):
            if inside:
                escaped = c == "\\" and not escaped
                inside = c != '"' or (i > 0 and text[i - 1] == "\\" and not escaped)
                continue
            inside = c == '"'
            depth += (c in "{[") - (c in "}]")
            if c == "," and depth == 1:
                last = i
            if depth == 0 and c == "}":
                last = -2
                break
        tries = [text] if last == -2 else [text + "}", text[:last] + "}"] if last > 0 and depth >= 1 else [text + "}"]
        for t in tries:
            try:
                if isinstance(json.loads(t), dict):
                    return t
            except ValueError:
                continue
        return None

    return raw.map(one)


def stalled(raw: Column, most: int = MOST_BLANKS) -> Column:
    """Whether text holds a longer run of white space outside its strings than any answer needs."""
    bare = F.regexp_replace(raw, r'"(?:[^"\\]|\\.)*"', '""')
    return bare.rlike(rf"\s{{{most + 1},}}")


def last_attempt(answers: DataFrame, call: str, attempt: str, usable: Column, reachable: Column) -> DataFrame:
    """One row for each call: its last attempt, and what it came to (ok, malformed or unavailable)."""
    nth = F.row_number().over(Window.partitionBy(call).orderBy(F.col(attempt).desc()))
    state = F.when(~reachable, "unavailable").when(usable, "ok").otherwise("malformed")
    return answers.withColumn("_nth", nth).where("_nth = 1").drop("_nth").withColumn("state", state)


def fresh_terms(proposed: DataFrame, known: DataFrame, by: str, term: str, order: str) -> DataFrame:
    """Proposed terms without blanks, known ones and repeats, spaces and case aside; the first of equals stays."""
    name = T.folded(T.collapse(term))
    there = known.select(by, name.alias("_name")).distinct()
    rows = proposed.withColumn(term, T.collapse(term)).where(F.col(term) != "").withColumn("_name", name).join(there, [by, "_name"], "left_anti")
    nth = F.row_number().over(Window.partitionBy(by, "_name").orderBy(order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_name")


def captions_kept(captions: DataFrame, n: str, caption: str, count: Column) -> DataFrame:
    """Captions that name an image of their batch and say something."""
    number = F.col(n).try_cast("int")
    return captions.where(number.between(1, count) & ~T.blank(caption))


def in_declared_order(keys: Column, value: Column) -> Column:
    """A map's values in the order of declared keys."""
    return F.transform(keys, lambda k: F.try_element_at(value, k))


def free_key(wanted: str, taken: set[str]) -> str:
    """A key that none has, by underscores in front."""
    while wanted in taken:
        wanted = f"_{wanted}"
    return wanted
