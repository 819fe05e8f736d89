"""Plain and delimited text: bytes to text to units.

A unit is a struct of kind (heading, text, table_row), text and path, the titles
of the headings above it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tessera.functions.batches import each_text

UNIT = "struct<kind:string,text:string,path:array<string>>"
# What a file is, by its extension first and its media type else.
FORMATS = {
    "txt": "text", "md": "text", "markdown": "text", "log": "text", "csv": "csv", "tsv": "tsv", "eml": "mail", "docx": "docx", "html": "html", "htm": "html",
    "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image", "pdf": "pdf",
}
MEDIA = {"text/plain": "text", "text/markdown": "text", "text/csv": "csv", "text/tab-separated-values": "tsv", "message/rfc822": "mail", "text/html": "html", "application/pdf": "pdf"}


def extension(name: Column) -> Column:
    """The extension of a file name in lower case; empty where there is none or nothing else."""
    return F.regexp_extract(F.lower(name), r"^.+\.([^.]*)$", 1)


def source_format(name: Column, media: Column) -> Column:
    """How a file is read; null where no reader knows it."""
    by_name = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    by_media = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    return F.coalesce(by_name[extension(name)], by_media[F.lower(media)], F.when(F.startswith(F.lower(media), F.lit("image/")), "image"))


# What the Western code page has in place of Latin-1's second block of controls.
CONTROLS = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
WESTERN = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are that, else as the Western code page; it never fails."""
    western = F.translate(F.decode(content, "iso-8859-1"), CONTROLS, WESTERN)
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(western)


_HEADING = re.compile(r"(#{1,6})\s+(\S.*?)\s*#*\s*$")


@F.pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType()), StructField("path", ArrayType(StringType()))])))
def text_units(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Blank lines end a unit; a heading of one to six ``#`` is its own and stands above what follows.

    One pass over a text's lines, whatever its length; a null text has no units.
    """

    def of(text: str | None) -> list[dict] | None:
        if text is None:
            return None
        units, block, above = [], [], []

        def close() -> None:
            if block:
                units.append({"kind": "text", "text": "\n".join(block), "path": [title for _, title in above]})
                block.clear()

        for line in text.split("\n"):
            heading = _HEADING.match(line)
            if heading:
                close()
                marks, title = len(heading[1]), heading[2].strip(" ")
                above[:] = [h for h in above if h[0] < marks]
                units.append({"kind": "heading", "text": title, "path": [t for _, t in above]})
                above.append((marks, title))
            elif line.strip(" "):
                block.append(line.rstrip(" "))
            else:
                close()
        close()
        return units

    return each_text(of)(columns)


def _cells(line: Column, delimiter: str, quoted: Column) -> Column:
    """Cells of a line; between quotes a delimiter is text, two quotes are one."""
    d = "\\t" if delimiter == "\t" else delimiter
    parts = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(f'{d}("(?:[^"]|"")*"|[^{d}]*)'), F.lit(1))
    bare = F.transform(parts, lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(quoted, bare).otherwise(F.split(line, d))


def csv_units(text: Column, delimiter: str = ",") -> Column:
    """A heading of the column names, then a unit for each row: ``name: cell · name: cell``, empty cells left out.

    An odd number of quotes means that they are no quotes. Text without a second
    line or with a blank first one is read as plain text.
    """
    body = F.regexp_replace(text, r"\n+$", "")
    quoted = F.pmod(F.char_length(body) - F.char_length(F.replace(body, F.lit('"'), F.lit(""))), F.lit(2)) == 0
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x) != "")
    head = F.transform(_cells(F.get(lines, F.lit(0)), delimiter, quoted), F.btrim)
    names = F.transform(head, lambda h, i: F.when(h == "", F.concat(F.lit("col"), (i + 1).cast("string"))).otherwise(h))

    def row(line: Column) -> Column:
        cells = F.transform(_cells(line, delimiter, quoted), F.btrim)
        pair = lambda c, i: F.when(c != "", F.concat(F.coalesce(F.get(names, i), F.concat(F.lit("col"), (i + 1).cast("string"))), F.lit(": "), c))
        return F.array_join(F.transform(cells, pair), " · ")

    path = F.array().cast("array<string>")
    top = F.struct(F.lit("heading").alias("kind"), F.array_join(names, " · ").alias("text"), path.alias("path")).cast(UNIT)
    rows = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), lambda x: F.struct(F.lit("table_row").alias("kind"), row(x).alias("text"), path.alias("path")).cast(UNIT))
    table = F.filter(F.concat(F.array(top), rows), lambda u: u["text"] != "")
    usable = (F.size(lines) > 1) & (F.btrim(F.get(F.split(body, "\n"), F.lit(0))) != "")
    return F.when(usable, table).otherwise(text_units(text))


def pasted_rows(text: Column, columns: dict[str, str]) -> Column:
    """Rows of a pasted table as maps by the declared columns (key to label).

    Tabs part cells where the first line has one, else commas. The first line
    names the columns if at least half of its cells, and one, are a key or label,
    case and signs aside; else cells are taken in declared order. Missing cells
    are empty, rows without any content are left out.
    """
    lines = F.filter(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.btrim(x) != "")
    first = F.get(lines, F.lit(0))
    quoted = F.pmod(F.char_length(text) - F.char_length(F.replace(text, F.lit('"'), F.lit(""))), F.lit(2)) == 0
    tabs = F.contains(first, F.lit("\t"))
    cells = lambda line: F.transform(F.when(tabs, _cells(line, "\t", quoted)).otherwise(_cells(line, ",", quoted)), lambda c: F.btrim(c))
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    head = F.transform(cells(first), bare)
    place = {k: F.coalesce(*[F.nullif(F.array_position(head, bare(F.lit(name))), F.lit(0)) for name in (k, label)]) for k, label in columns.items()}
    known = sum((F.when(at.isNotNull(), 1).otherwise(0) for at in place.values()), F.lit(0))
    named = known >= F.greatest(F.lit(1), F.floor(F.size(head) / 2))
    body = F.when(named, F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))).otherwise(lines)

    def row(line: Column) -> Column:
        at = lambda k, i: F.when(named, (place[k] - 1).cast("int")).otherwise(i)
        return F.create_map(*[x for i, k in enumerate(columns) for x in (F.lit(k), F.coalesce(F.get(cells(line), at(k, i)), F.lit("")))])

    return F.filter(F.transform(body, row), lambda r: F.exists(F.map_values(r), lambda v: v != ""))


def page_paragraphs(page: Column) -> Column:
    """Lines of a page as paragraphs: words broken at a line end joined again, blank lines between paragraphs."""
    lines = F.regexp_replace(page, r"(?m)^[ \t]+|[ \t]+$", "")
    joined = F.regexp_replace(F.regexp_replace(lines, r"-\n(?=\p{Ll})", ""), r"-\n(?=\S)", "-")
    apart = F.split(joined, r"\n{2,}")
    return F.filter(F.transform(apart, lambda p: F.btrim(F.regexp_replace(p, "\n", " "))), lambda p: p != "")


def is_scan(pages: DataFrame, source: str, text: str, least: int = 10) -> DataFrame:
    """Per source whether its pages hold too few characters to be text."""
    return pages.groupBy(source).agg((F.sum(F.char_length(F.btrim(F.coalesce(F.col(text), F.lit(""))))) < least * F.greatest(F.count("*"), F.lit(1))).alias("scan"))


def joined_text(units: Column) -> Column:
    """A source's text: its units with blank lines between."""
    return F.array_join(F.transform(units, lambda u: u["text"]), "\n\n")
