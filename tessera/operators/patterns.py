"""Pattern search over passages, with offsets in code points.

Patterns of our own run as built-in expressions. Patterns that people type run
in an Arrow function with a timeout, as Java's have none; a pattern that takes
too long on a passage gives a row with an error instead of hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.batches import pieces

HITS_A_PASSAGE = 200
HITS_A_COMMAND = 400
TIMEOUT = 2.0
PART = 256
SPAN = "array<struct<value:string,char_from:int,char_to:int>>"


class PatternError(ValueError):
    """A pattern that must not run."""


def compiled(pattern: str):
    """The compiled pattern; blank, broken and empty-matching ones are refused."""
    import regex

    if not (pattern or "").strip():
        raise PatternError("the pattern is blank")
    try:
        found = regex.compile(pattern)
    except regex.error as e:
        raise PatternError(f"the pattern is broken: {e}") from e
    if found.match(""):
        raise PatternError("the pattern matches nothing at all")
    return found


def unmatched(pattern: str, examples: list[str]) -> list[str]:
    """Examples that the pattern does not match from end to end."""
    whole = compiled(pattern)
    return [x.strip() for x in examples if (x or "").strip() and not whole.fullmatch(x.strip(), timeout=1.0)]


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All non-overlapping matches of a vetted pattern as values with offsets.

    What lies between matches and the matches alternate, so their lengths add up
    to the offsets. With a group, the value is the group's and the offsets are
    those of the whole match.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    items = F.zip_with(between, F.arrays_zip(whole.alias("w"), value.alias("v")), lambda b, m: F.struct(F.char_length(b).alias("gap"), F.char_length(m["w"]).alias("n"), m["v"].alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    none = F.array().cast(SPAN)

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        hit = F.struct(x["v"].alias("value"), begin.alias("char_from"), (begin + x["n"]).alias("char_to"))
        return F.struct((begin + x["n"]).alias("at"), F.array_append(s["out"], hit).alias("out"))

    # Part by part, so that the array which grows with each match stays short; then every part is moved to its place.
    part_of = lambda found: F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PART).cast("int")), lambda k: F.aggregate(F.slice(found, k * PART + 1, F.lit(PART)), start, step))
    parts = F.flatten(F.transform(F.filter(F.array(items), lambda found: F.size(found) > 0), part_of))
    placed = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,out:{SPAN}>>").alias("parts"))
    after = lambda s, p: F.struct((s["at"] + p["at"]).alias("at"), F.array_append(s["parts"], F.struct(s["at"].alias("at"), p["out"].alias("out"))).alias("parts"))
    moved = lambda p: F.transform(p["out"], lambda h: F.struct(h["value"].alias("value"), (h["char_from"] + p["at"]).alias("char_from"), (h["char_to"] + p["at"]).alias("char_to")))
    return F.coalesce(F.aggregate(parts, placed, after, lambda s: F.flatten(F.transform(s["parts"], moved))), none)


def native_hits(passages: DataFrame, text: str, pattern: str, group: int = 0, guard: str | None = None) -> DataFrame:
    """A row for each match of a vetted pattern: the passage's columns, pos, value, char_from, char_to."""
    some = passages.where(F.col(text).rlike(guard or pattern))
    return some.select("*", F.posexplode(spans(F.col(text), pattern, group)).alias("pos", "_hit")).select("*", "_hit.*").drop("_hit")


def hits(passages: DataFrame, key: str, text: str, pattern: str, *, timeout: float = TIMEOUT, limit: int = HITS_A_PASSAGE) -> DataFrame:
    """A row for each match of a typed pattern: ``key``, pos, value, char_from, char_to, quote, error.

    With exactly one group the group is the value, else the whole match. The
    first ``limit`` matches of a passage count, blank values among them are then
    left out. Null texts have none. An error has no value.
    """
    group = 1 if compiled(pattern).groups == 1 else 0
    kind = dict(passages.dtypes)[key]
    names = ["key", "pos", "value", "char_from", "char_to", "begin", "end", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = compiled(pattern)
        for batch in pieces(batches, 1):
            who, rows = [], []
            for i, text_of in enumerate(batch.column(1).to_pylist()):
                if text_of is None:
                    continue
                try:
                    found = [m for m, _ in zip(find.finditer(text_of, timeout=timeout), range(limit), strict=False)]
                except TimeoutError:
                    who.append(i)
                    rows.append((0, None, None, None, None, None, "too slow"))
                    continue
                for pos, m in enumerate(found):
                    if (m.group(group) or "").strip():
                        who.append(i)
                        rows.append((pos, m.group(group).strip(), m.start(group), m.end(group), m.start(), m.end(), None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            keys = batch.column(0).take(pa.array(who, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    schema = f"`{key}` {kind}, pos int, value string, char_from int, char_to int, `begin` int, `end` int, error string"
    return passages.select(key, text).mapInArrow(run, schema)


def with_quotes(found: DataFrame, passages: DataFrame, key: str, text: str) -> DataFrame:
    """Hits with the words around their matches."""
    joined = found.join(passages.select(key, F.col(text).alias("_text")), key)
    return joined.withColumn("quote", T.window("_text", F.col("begin"), F.col("end"))).drop("_text", "begin", "end")


def capped(found: DataFrame, by: list[str], order: list[Column], most: int = HITS_A_COMMAND) -> DataFrame:
    """The first hits of each command in document order."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return found.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def preview(found: DataFrame, order: list[Column], most: int = 12) -> DataFrame:
    """The first hits of all."""
    return found.orderBy(*order).limit(most)
