"""Files to sources with units: one row for each file, with an error in place of units where it cannot be read."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.batches import pieces
from tessera.sources import mail, office, pages, plain

MOST_BYTES = 25 << 20
UNITS = "array<" + plain.UNIT + ">"
MESSAGES = "array<struct<kind:string,text:string,path:array<string>,sender:string,sender_domain:string,separator:string,sent_on:date>>"
ATTACHED = "array<struct<name:string,media:string,content:binary>>"


def files(spark: SparkSession, path: str, *, glob: str = "*") -> DataFrame:
    """``path``, name, content and length of all files of a folder and its subfolders, in any store that Spark reads; files without a byte are passed over."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content", "length")


def _composed(rows: DataFrame) -> DataFrame:
    """Rows with composed texts in their units, and composed titles of the way to them."""
    at = rows.columns.index("units")

    def nfc(texts: pa.Array) -> pa.Array:
        if pc.all(pc.string_is_ascii(texts)).as_py() is not False:
            return texts
        return pa.array([text and unicodedata.normalize("NFC", text) for text in texts.to_pylist()], texts.type)

    def lists(like: pa.ListArray, values: pa.Array) -> pa.ListArray:
        """Lists as long as those of ``like``, of other values."""
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(like), 0))
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), values, type=like.type, mask=like.is_null())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            column = batch.column(at)
            units = column.flatten()
            own = {"text": nfc(units.field("text")), "path": lists(units.field("path"), nfc(units.field("path").flatten()))}
            fields = list(column.type.value_type)
            made = pa.StructArray.from_arrays([own[f.name] if f.name in own else units.field(f.name) for f in fields], fields=fields, mask=units.is_null())
            yield batch.set_column(at, batch.schema.field(at), lists(column, made))

    return rows.mapInArrow(run, rows.schema)


def _with_clean(rows: DataFrame) -> DataFrame:
    """Rows whose units have clean, composed texts; units that are blank then are gone.

    In one pass: to take rows beyond ASCII apart would read every file twice.
    """
    clean = F.transform("units", lambda u: u.withField("text", T.plain_clean(u["text"])))
    return _composed(rows.withColumn("units", F.filter(clean, lambda u: F.btrim(u["text"]) != "")))


def read(found: DataFrame, *, key: str = "path", media: str | None = None, formats: Iterable[str] = ("html", "mail", "docx")) -> DataFrame:
    """``key``, format, units, error, subject, sender, sent and attachments of every file.

    Text, delimited text and pages are read by expressions, mails and Word files
    in Arrow functions that only their rows reach. Empty and too large files,
    formats without a reader and files without text or attachments have an error.
    Units are structs of kind, text, path and, in mails, who wrote them. Where it
    is known which ``formats`` occur, readers of others are left out of the plan.
    """
    kinds = plain.source_format(F.col("name"), F.col(media) if media else F.lit(None).cast("string"))
    rows = found.select(key, "content", kinds.alias("format"), F.octet_length("content").alias("_n"))
    text = plain.decoded(F.col("content"))
    body = F.regexp_replace(text, r"\r\n?", "\n")
    nothing = F.lit(None).cast(UNITS)
    bad = F.when(F.col("_n") == 0, "the file is empty").when(F.col("_n") > MOST_BYTES, "the file is too large").when(F.col("format").isNull() | F.col("format").isin("image", "pdf"), "no reader for this format")
    inline = F.when(F.col("format") == "csv", plain.csv_units(body)).when(F.col("format") == "tsv", plain.csv_units(body, "\t")).when(F.col("format") == "text", plain.text_units(body))
    of_mail = ["subject", "sender", "sent", "attachments"]
    told = lambda units, error, *own: [key, "format", _as_messages(units).alias("units"), error.alias("error"), *(own or [F.lit(None).cast(ATTACHED if c == "attachments" else "string").alias(c) for c in of_mail])]
    none = F.lit(None).cast("string")
    fine = rows.withColumn("error", bad)
    texts = fine.where("error is not null or format in ('text', 'csv', 'tsv')").select(*told(F.when(F.col("error").isNull(), inline).otherwise(nothing), F.col("error")))
    good = fine.where("error is null")
    every = [texts]
    if "html" in formats:
        every.append(good.where("format = 'html'").select(*told(plain.text_units(pages.faithful(text)), none)))
    if "mail" in formats:
        letters = mail.parsed(good.where("format = 'mail'").select(key, "content"), key, "content").withColumn("format", F.lit("mail"))
        who = mail.sender(F.col("sender"))["address"]
        units = mail.message_units(F.col("body"), who, F.col("subject")).cast(MESSAGES)
        letters = letters.select(key, "format", units.alias("units"), "error", "subject", who.alias("sender"), "sent", "attachments")
        every.append(letters)
    if "docx" in formats:
        word = office.parsed(good.where("format = 'docx'").select(key, "content"), key, "content").withColumn("format", F.lit("docx"))
        word = word.select(*told(F.col("units").cast(UNITS), F.col("error")))
        every.append(word)
    every = _with_clean(reduce(DataFrame.unionByName, every))
    empty = (F.coalesce(F.size("units"), F.lit(0)) <= 0) & (F.coalesce(F.size("attachments"), F.lit(0)) <= 0)
    return every.withColumn("error", F.coalesce("error", F.when(empty, "the file has no text")))


def _as_messages(units: Column) -> Column:
    """Units of files that do not say who wrote them, in the shape of those that do."""
    no = lambda kind: F.lit(None).cast(kind)
    return F.transform(
        units,
        lambda u: F.struct(u["kind"].alias("kind"), u["text"].alias("text"), u["path"].alias("path"), no("string").alias("sender"), no("string").alias("sender_domain"), no("string").alias("separator"), no("date").alias("sent_on")),
    ).cast(MESSAGES)


def absorbed(found: DataFrame, *, key: str = "path", media: str | None = None) -> DataFrame:
    """``key``, format, units and error of every file, see :func:`read`."""
    return read(found, key=key, media=media).select(key, "format", "units", "error")
