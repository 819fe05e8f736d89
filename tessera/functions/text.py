"""Text functions on columns: cleaning, keys, quotes, windows, display.

All are built-in expressions but those that compose, take marks off, read JSON
or compare word by word, for which Spark has no function; those are Arrow
functions over whole columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessera.functions.batches import each_text

# Spaces that are read as a space, breaks that are read as a newline.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
BREAKS = "\u000c\u0085\u2028\u2029"
# Fixed value: punctuation that does not belong to a value at its edges.
EDGE = ".,;:!?\"'()[]{}«»„“”‚‘’<>"
HIDDEN = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}&&[^\t\n]]"
BEYOND_ASCII = r"[^\x00-\x7f]"


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain_clean(c: Column | str) -> Column:
    """Line ends as newlines, odd spaces as spaces, hidden characters gone; not composed."""
    text = F.regexp_replace(_text(c), r"\r\n?", "\n")
    text = F.translate(text, SPACES + BREAKS, " " * len(SPACES) + "\n" * len(BREAKS))
    return F.regexp_replace(text, HIDDEN, "")


@F.pandas_udf(StringType())
def compose(texts: pd.Series) -> pd.Series:
    """The canonical composition (NFC) of each text."""
    return texts.str.normalize("NFC")


@F.pandas_udf(StringType())
def _unaccented(texts: pd.Series) -> pd.Series:
    import unicodedata

    def fold(text: str | None) -> str | None:
        if text is None:
            return None
        apart = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
        return "".join(x for x in apart if not unicodedata.combining(x))

    return texts.map(fold)


@F.pandas_udf(StringType())
def cleaned(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """:func:`plain_clean` and :func:`compose` in one pass; texts of printable ASCII pass as they are."""
    import re
    import unicodedata

    odd = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")
    spaces = {ord(c): " " for c in SPACES} | {ord(c): "\n" for c in BREAKS}
    hidden: dict[str, bool] = {}

    def is_hidden(c: str) -> bool:
        if c not in hidden:
            hidden[c] = c not in "\t\n" and unicodedata.category(c) in ("Cc", "Cf", "Cs", "Co")
        return hidden[c]

    def of(text: str | None) -> str | None:
        if text is None or (text.isascii() and not odd.search(text)):
            return text
        text = text.replace("\r\n", "\n").replace("\r", "\n").translate(spaces)
        gone = [c for c in set(text) if is_hidden(c)]
        if gone:
            text = text.translate(dict.fromkeys(map(ord, gone)))
        return unicodedata.normalize("NFC", text)

    return each_text(of)(columns)


def with_clean(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """``df`` with the cleaned, composed text, in one scan. Null stays null."""
    return df.withColumn(name or column, cleaned(F.col(column)))


def with_deaccented(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """``df`` with ß as ss and all marks gone, in the compatibility form."""
    name = name or column
    ready = df.withColumn(name, _text(column))
    needs = F.coalesce(F.col(name).rlike(BEYOND_ASCII), F.lit(False))
    return ready.where(~needs).unionByName(ready.where(needs).withColumn(name, _unaccented(F.col(name))))


def collapse(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(_text(c), r"(?U)\s+", " "))


def clean_line(c: Column | str) -> Column:
    return collapse(plain_clean(c))


def folded(c: Column | str) -> Column:
    """Case folded: lower case, and ß as ss."""
    return F.replace(F.lower(_text(c)), F.lit("ß"), F.lit("ss"))


def edge_trimmed(c: Column | str) -> Column:
    return F.btrim(_text(c), F.lit(EDGE + " "))


def slug(c: Column | str, longest: int = 60, fallback: str = "question") -> Column:
    """A key of a name whose marks are gone: ``[a-z0-9]`` runs joined by ``_``."""
    key = F.btrim(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    key = F.rtrim(F.substring(key, 1, longest), F.lit("_"))
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit(fallback)).otherwise(key)


def spec_slug(c: Column | str, longest: int = 60) -> Column:
    """A key of a title: no digit first; a long one ends at the last ``_`` beyond its middle."""
    key = F.btrim(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    key = F.when(key.rlike("^[0-9]"), F.concat(F.lit("_"), key)).otherwise(key)
    cut = F.substring(key, 1, longest)
    whole_words = F.regexp_replace(cut, "_[^_]*$", "")
    short = F.when(F.char_length(whole_words) > longest // 2, whole_words).otherwise(cut)
    return F.when(F.char_length(key) > longest, short).otherwise(key)


def quoted_from(quote: Column | str, source: Column | str, first_words: int = 8) -> Column:
    """Whether the source has the quote, case and spaces aside; a longer quote passes on its first words."""
    q, s = folded(collapse(quote)), folded(collapse(source))
    words = F.split(q, " ")
    begin = F.array_join(F.slice(words, 1, first_words), " ")
    found = F.contains(s, q) | ((F.size(words) > first_words) & F.contains(s, begin))
    return F.coalesce((q != "") & found, F.lit(False))


def says_no_more(quote: Column | str, value: Column | str) -> Column:
    """Whether the quote's letters and digits all stand in the value's, in one run."""
    bare = lambda c: folded(F.regexp_replace(_text(c), r"(?U)[^\p{L}\p{N}]+", ""))
    return F.coalesce(F.contains(bare(value), bare(quote)), F.lit(False))


def window(text: Column | str, begin: Column, end: Column, size: int = 160) -> Column:
    """The words around the span from ``begin`` to ``end`` (code points, end exclusive), marked where cut."""
    text = _text(text)
    length = F.char_length(text)
    low, high = F.greatest(begin - size, F.lit(0)), F.least(end + size, length)
    before = F.substring(text, (low + 1).cast("int"), (begin - low).cast("int"))
    gap = F.instr(before, " ")
    low = F.when((low > 0) & (gap > 0), low + gap).otherwise(low)
    after = F.substring(text, (end + 1).cast("int"), (high - end).cast("int"))
    kept = F.regexp_extract(after, r"^(?s)(.*) ", 1)
    high = F.when((high < length) & F.contains(after, F.lit(" ")), end + F.char_length(kept)).otherwise(high)
    body = collapse(F.substring(text, (low + 1).cast("int"), (high - low).cast("int")))
    return F.concat(F.when(low > 0, "…").otherwise(""), body, F.when(high < length, "…").otherwise(""))


def context(text: Column | str, begin: Column, end: Column, size: int = 600) -> Column:
    """The paragraphs around a span, else the words around it."""
    text = _text(text)
    low, high = F.greatest(begin - size, F.lit(0)), F.least(end + size, F.char_length(text))
    before = F.substring(text, (low + 1).cast("int"), (begin - low).cast("int"))
    at_paragraph, at_word = F.locate("\n\n", before), F.locate(" ", before)
    low = F.when(low == 0, low).when(at_paragraph > 0, low + at_paragraph + 1).when(at_word > 0, low + at_word).otherwise(low)
    after = F.substring(text, (end + 1).cast("int"), (high - end).cast("int"))
    cut = F.when(F.contains(after, F.lit("\n\n")), F.regexp_extract(after, r"^(?s)(.*)\n\n", 1)).when(F.contains(after, F.lit(" ")), F.regexp_extract(after, r"^(?s)(.*) ", 1))
    high = F.when(high == F.char_length(text), high).otherwise(F.coalesce(end + F.char_length(cut), high))
    return F.btrim(F.substring(text, (low + 1).cast("int"), (high - low).cast("int")))


def word_count(c: Column | str) -> Column:
    """Words between white space; none in a blank or null text."""
    words = F.filter(F.split(F.coalesce(_text(c), F.lit("")), r"(?U)\s+"), lambda w: w != "")
    return F.size(words)


def blank(c: Column | str) -> Column:
    return F.coalesce(collapse(c) == "", F.lit(True))


def without_marker(c: Column | str) -> Column:
    """A line without its list marker."""
    return F.regexp_replace(_text(c), r"^[\s\-*•·>–—.:;]+", "")


def without_number(title: Column | str, number: Column) -> Column:
    """A title without its own step number in front."""
    return F.regexp_replace(_text(title), F.concat(F.lit(r"^\s*"), number.cast("string"), F.lit(r"\s*[.):\-–]\s*")), F.lit(""))


def listed(items: Column) -> Column:
    """``A``, ``A and B`` or ``A, B and C``; nothing for no items."""
    head = F.array_join(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(1))), ", ")
    return F.when(F.size(items) == 0, "").when(F.size(items) == 1, F.element_at(items, 1)).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """``1 passage``, ``3 passages``."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


def answer_text(c: Column | str) -> Column:
    """An answer as shown: yes or no for booleans, spaces in keys."""
    text = _text(c)
    return (
        F.when(F.lower(text) == "true", "Yes").when(F.lower(text) == "false", "No").when(text.rlike(r"^[a-z0-9_]+$"), F.replace(text, F.lit("_"), F.lit(" "))).otherwise(text)
    )


def stamp(c: Column | str, zone: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(_text(c), zone), "yyyy-MM-dd HH:mm")


def filename(title: Column | str, longest: int = 80) -> Column:
    """Letters, digits, spaces, ``-`` and ``_`` of a title, blanks as ``-``."""
    kept = F.btrim(F.regexp_replace(_text(title), r"(?U)[^\p{L}\p{N} _-]", ""))
    return F.substring(F.regexp_replace(kept, r"(?U)[\s-]+", "-"), 1, longest)


def redacted_url(c: Column | str) -> Column:
    """A URL whose password is hidden."""
    return F.regexp_replace(_text(c), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^:/@]*):[^@/]*@", "$1:***@")


@F.pandas_udf(ArrayType(StructType([StructField("from", IntegerType()), StructField("to", IntegerType())])))
def _marked(texts: pd.Series, passages: pd.Series) -> pd.Series:
    def of(text: str | None, sought: object) -> list[dict[str, int]] | None:
        if text is None:
            return None
        found = []
        for passage in [] if sought is None else sought:
            at = text.find(passage) if passage else -1
            while at >= 0:
                found.append((at, at + len(passage)))
                at = text.find(passage, at + len(passage))
        out: list[dict[str, int]] = []
        for begin, end in sorted(found):
            if out and begin <= out[-1]["to"]:
                out[-1]["to"] = max(out[-1]["to"], end)
            else:
                out.append({"from": begin, "to": end})
        return out

    return pd.Series([of(t, p) for t, p in zip(texts, passages, strict=True)])


def marked(text: Column | str, passages: Column) -> Column:
    """Spans (``from``, ``to``, end exclusive) of all passages in a text, case aside, those that touch merged."""
    return _marked(F.lower(_text(text)), F.transform(passages, F.lower))


def apart(spans: Column) -> Column:
    """Spans in order, those left out that begin before the one kept last ends."""
    none = F.struct(F.lit(0).alias("at"), F.filter(spans, lambda s: F.lit(False)).alias("out"))

    def step(state: Column, s: Column) -> Column:
        free = s["from"] >= state["at"]
        return F.struct(F.when(free, s["to"]).otherwise(state["at"]).alias("at"), F.when(free, F.array_append(state["out"], s)).otherwise(state["out"]).alias("out"))

    return F.aggregate(F.array_sort(spans), none, step, lambda s: s["out"])


@F.pandas_udf(ArrayType(StructType([StructField("op", StringType()), StructField("text", StringType())])))
def word_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """What was kept, deleted and inserted between two texts, by words, spaces and signs."""
    import difflib
    import re

    token = re.compile(r"\s+|\w+|[^\w\s]")

    def of(a: str | None, b: str | None) -> list[dict[str, str]]:
        x, y = token.findall(a or ""), token.findall(b or "")
        out = []
        for op, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if op == "equal":
                out.append({"op": "keep", "text": "".join(x[i:j])})
                continue
            if j > i:
                out.append({"op": "delete", "text": "".join(x[i:j])})
            if m > k:
                out.append({"op": "insert", "text": "".join(y[k:m])})
        return out

    return pd.Series([of(a, b) for a, b in zip(before, after, strict=True)])


@F.pandas_udf(StringType())
def clean_data(data: pd.Series) -> pd.Series:
    """JSON with every string cleaned and composed and every key a clean line, however deep; what is no JSON is null."""
    import json
    import re
    import unicodedata

    table = {ord(c): " " for c in SPACES} | {ord(c): "\n" for c in BREAKS}

    def clean(text: str) -> str:
        plain = re.sub(r"\r\n?", "\n", text).translate(table)
        shown = (c for c in plain if c in "\t\n" or unicodedata.category(c) not in ("Cc", "Cf", "Cs", "Co"))
        return unicodedata.normalize("NFC", "".join(shown))

    def within(value: object) -> object:
        if isinstance(value, str):
            return clean(value)
        if isinstance(value, list):
            return [within(v) for v in value]
        return {" ".join(clean(k).split()): within(v) for k, v in value.items()} if isinstance(value, dict) else value

    def of(raw: str | None) -> str | None:
        try:
            return json.dumps(within(json.loads(raw)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return data.map(of)
