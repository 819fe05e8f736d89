"""Mails: headers, senders, replies, and bodies with their attachments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from email import policy
from email.parser import BytesParser
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tessera.functions.batches import pieces

ADDRESS = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
# Fixed value: what may stand in angle brackets as an address; a domain needs no dot there.
ANGLED = r"<([^<>@\s,;\"]+@[^<>@\s,;\"]+)>"
# Fixed value: lines from which on a mail is a signature or a notice.
SIGN_OFF = r"(?im)^[ \t]*(?:--[ \t]*|_{5,}|Sent from my .*|Von meinem .* gesendet.*|(?:This e-?mail|This message|Diese E-?Mail|Diese Nachricht)\b.*(?:confidential|vertraulich).*)$"
# Fixed value: lines that begin an earlier mail of a thread.
SEPARATOR = r"^(?:-{2,}\s*(?:Original Message|Ursprüngliche Nachricht|Forwarded message)\s*-{2,}|On .+ wrote:|Am .+ schrieb .*:|From: .+|Von: .+)$"

# Headers of up to so many characters are kept, so many of them: a list of addresses takes some 600 bytes for each character.
KEPT_CHARS, KEPT = 200, 512
_SEPARATOR, _QUOTING = re.compile(SEPARATOR), re.compile(r"^(\s*>)+\s*")


def domain_of(address: Column) -> Column:
    """What stands behind the last ``@`` in lower case, without signs at its ends; null if that is nothing."""
    after = F.when(F.contains(address, F.lit("@")), F.element_at(F.split(address, "@"), -1))
    return F.nullif(F.lower(F.btrim(after, F.lit("<>\"'()[];:,. "))), F.lit(""))


def sender(header: Column) -> Column:
    """``address`` and ``name``: the address in angle brackets, one that is all there is, or else the first one, and the words before it."""
    first = lambda pattern, group: F.nullif(F.regexp_extract(header, pattern, group), F.lit(""))
    address = F.coalesce(first(ANGLED, 1), first(r"^\s*([^<>@\s,;\":]+@[^<>@\s,;\"]+)\s*$", 1), first(ADDRESS, 0))
    before = F.regexp_extract(header, r"^(?:.*:)?\s*([^<:]*?)\s*<", 1)
    return F.struct(F.lower(address).alias("address"), F.nullif(F.btrim(before, F.lit("\"' ")), F.lit("")).alias("name"))


def addresses(header: Column) -> Column:
    return F.transform(F.regexp_extract_all(header, F.lit(ADDRESS), F.lit(0)), F.lower)


def loose_date(line: Column) -> Column:
    """A date in a separator: day first, and an impossible one is none; else ISO."""
    dmy = F.regexp_extract(line, r"\d{1,2}\.\d{1,2}\.\d{4}", 0)
    iso = F.regexp_extract(line, r"\d{4}-\d{2}-\d{2}", 0)
    return F.when(dmy != "", F.try_to_date(dmy, "d.M.yyyy")).otherwise(F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"))


def unquoted(paragraph: Column) -> Column:
    """A paragraph without the marks of quoting, its lines joined."""
    lines = F.transform(F.split(paragraph, "\n"), lambda x: F.btrim(F.regexp_replace(x, r"^(\s*>)+\s*", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


@F.pandas_udf(S.ArrayType(S.StructType([S.StructField("no", S.IntegerType()), S.StructField("separator", S.StringType()), S.StructField("text", S.StringType())])))
def thread(bodies: pd.Series) -> pd.Series:
    """A mail cut at the lines that begin an earlier one, in one pass over its lines; replies without words are left out, but counted."""

    def cut(text: str | None) -> list[dict] | None:
        if text is None:
            return None
        number, separator, lines, found = 0, None, [], []
        for line in [*text.split("\n"), None]:
            if line is not None and not _SEPARATOR.match(_QUOTING.sub("", line)):
                lines.append(line)
                continue
            said = "\n".join(lines).strip("\n ")
            if said:
                found.append({"no": number, "separator": separator, "text": said})
            number, separator, lines = number + 1, line and line[:300], []
        return found

    return bodies.map(cut)


def replies(mails: DataFrame, key: str, body: str) -> DataFrame:
    """``key``, reply_no, separator, sender, sent_on and text: a thread cut at the lines that begin an earlier mail."""
    rows = mails.select(key, F.explode(thread(F.col(body).cast("string"))).alias("_r"))
    separator = F.nullif(F.col("_r.separator"), F.lit(""))
    return rows.select(key, F.col("_r.no").alias("reply_no"), separator.alias("separator"), sender(separator)["address"].alias("sender"), loose_date(separator).alias("sent_on"), F.col("_r.text").alias("text"))


def signed_off(text: Column) -> Column:
    """A reply without its signature and what follows."""
    return F.split(text, SIGN_OFF, 2)[0]


def message_units(body: Column, own_sender: Column, subject: Column) -> Column:
    """A mail's paragraphs as units, each with who wrote it: kind, text, path, sender, sender_domain, separator, sent_on.

    The first reply is the mail's own; later ones say in their separator who
    wrote them. Signatures are cut, marks of quoting are gone.
    """
    trail = F.when(F.btrim(subject) != "", F.array(F.btrim(subject))).otherwise(F.array().cast("array<string>"))

    def of_reply(reply: Column) -> Column:
        separator = F.nullif(F.btrim(F.regexp_replace(reply["separator"], r"\s+", " ")), F.lit(""))
        who = F.when(reply["no"] == 0, own_sender).otherwise(sender(reply["separator"])["address"])
        texts = F.filter(F.transform(F.split(signed_off(reply["text"]), r"\n[ \t]*\n"), unquoted), lambda t: t != "")
        return F.transform(
            texts,
            lambda t: F.struct(F.lit("message").alias("kind"), t.alias("text"), trail.alias("path"), who.alias("sender"), domain_of(who).alias("sender_domain"), separator.alias("separator"), loose_date(reply["separator"]).alias("sent_on")),
        )

    return F.flatten(F.transform(thread(F.regexp_replace(body, r"\r\n?", "\n")), of_reply))


@lru_cache(KEPT)
def _header(name: str, value: str) -> str:
    return policy.default.header_fetch_parse(name, value)


class _Headers(policy.EmailPolicy):
    """The default policy, which takes a header apart whenever it is asked for: a mail's parts ask for theirs many times."""

    def header_fetch_parse(self, name: str, value: str) -> str:
        return _header(name, value) if type(value) is str and len(value) <= KEPT_CHARS else super().header_fetch_parse(name, value)


def parsed(files: DataFrame, key: str, content: str) -> DataFrame:
    """``key``, subject, sender, sent, body, attachments (name, media, bytes) and error of mails as bytes.

    The body is the plain part, else the HTML part as text. A mail that cannot be
    read gives its error and nulls.
    """
    kind = dict(files.dtypes)[key]

    def attached_file(part) -> dict:
        """A mail that is attached is a file like any, named by its subject."""
        if part.get_content_type() == "message/rfc822":
            inner = part.get_content()
            return {"name": part.get_filename() or f"{inner['subject'] or 'mail'}.eml", "media": "message/rfc822", "content": inner.as_bytes()}
        return {"name": part.get_filename(), "media": part.get_content_type(), "content": part.get_payload(decode=True)}

    attached = pa.list_(pa.struct([("name", pa.string()), ("media", pa.string()), ("content", pa.binary())]))
    names = ["key", "subject", "sender", "sent", "body", "attachments", "error"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), attached, pa.string()]

    def one(raw: bytes | None) -> tuple:
        from tessera.sources.pages import page_text

        try:
            mail = BytesParser(policy=_Headers()).parsebytes(raw or b"")
            part = mail.get_body(preferencelist=("plain", "html"))
            body = part.get_content() if part is not None else ""
            if part is not None and part.get_content_type() == "text/html":
                body = page_text(body)
            files = [attached_file(a) for a in mail.iter_attachments()]
            return mail["subject"], mail["from"], mail["date"], body, files, None
        except Exception as e:  # a broken mail is a row with its error, never a failed job
            return None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            rows = [one(x) for x in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            texts = [[None if v is None else str(v) for v in c] if i != 4 else list(c) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(texts, types, strict=True)]], names)

    schema = f"`{key}` {kind}, subject string, sender string, sent string, body string, attachments array<struct<name:string,media:string,content:binary>>, error string"
    return files.select(key, content).mapInArrow(run, schema)
