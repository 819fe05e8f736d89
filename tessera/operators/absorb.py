"""Files and all that is attached to them, to any depth, as sources with units, language and passages.

Level by level: the files of a level are read, what is attached to them is the
next level, until nothing new comes. Contents are addressed by their digest and
read once, whatever the number of files that have them; a file whose content its
case already has is a repeat, which is listed and not opened, so nothing that
contains itself is opened twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import words as W
from tessera.operators import language, split
from tessera.session import checkpointed
from tessera.sources import files, mail, plain

PART_BYTES, PART_ROWS = 4 << 20, 4000
INHERITED = ("sender", "sent")
TOLD = ("units", "error", "subject", "sender", "sent")


def absorb(found: DataFrame, *, case: str = "case", key: str = "path") -> DataFrame:
    """One row per source: ``case``, ``key``, parent, depth, name, format, digest, status, error, units, subject, sender, sender_domain, sent.

    ``found`` has ``case``, ``key`` (a string), name, content and, if known, media. An
    attachment's key is that of its mail, a ``!`` and its number. Of a case's
    files with one content the least deep counts, then the first by key; the others
    are ``repeat``. A source that cannot be read is ``failed`` with its error, the
    rest is ``parsed``. Attachments that do not say who sent them and when have
    that of their mail. A null content is an empty file.
    """
    media = F.col("media") if "media" in found.columns else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    level = found.select(F.col(case).alias("case"), F.col(key).cast("string").alias("key"), none.alias("parent"), F.lit(0).alias("depth"), "name", media.alias("media"), F.coalesce("content", F.lit("").cast("binary")).alias("content"))
    level = level.withColumns({f"from_{c}": none for c in INHERITED})
    levels, read = [], None
    while True:
        level = checkpointed(level.withColumns({"digest": F.sha2("content", 256), "format": F.coalesce(plain.source_format(F.col("name"), F.col("media")), F.lit(""))}))
        size = level.agg(F.count("*").alias("rows"), F.sum(F.octet_length("content")).alias("bytes"), F.collect_set("format").alias("formats")).first()
        if not size.rows:
            break
        contents = level.select(F.struct("digest", "format").alias("what"), "name", "media", "content")
        if read is not None:
            contents = contents.join(read.select(F.struct("digest", "format").alias("what")), "what", "left_anti")
        contents = _dealt(contents.dropDuplicates(["what"]), size.rows, size.bytes)
        got = files.read(contents, key="what", media="media", formats=size.formats)
        got = checkpointed(got.select("what.digest", "what.format", *TOLD, "attachments"))
        read = got if read is None else read.unionByName(got)
        rows = checkpointed(_told(level.drop("content", "media"), read, levels))
        levels.append(rows)
        below = rows.where("counts and size(attachments) > 0").select("case", F.col("key").alias("parent"), (F.col("depth") + 1).alias("depth"), *[F.col(c).alias(f"from_{c}") for c in INHERITED], F.posexplode("attachments").alias("n", "file"))
        level = below.select("case", F.concat("parent", F.lit("!"), F.col("n").cast("string")).alias("key"), "parent", "depth", "file.name", "file.media", F.coalesce("file.content", F.lit("").cast("binary")).alias("content"), *[f"from_{c}" for c in INHERITED])
    columns = ["case", "key", "parent", "depth", "name", "format", "digest", "status", *TOLD]
    if not levels:
        every = level.select(*columns[:7], none.alias("status"), F.lit(None).cast(files.MESSAGES).alias("units"), *[none.alias(c) for c in TOLD[1:]])
    else:
        every = reduce(DataFrame.unionByName, [rows.select(*columns) for rows in levels])
    return every.select(F.col("case").alias(case), F.col("key").alias(key), "parent", "depth", "name", "format", "digest", "status", "error", "units", "subject", "sender", mail.domain_of(F.col("sender")).alias("sender_domain"), "sent")


def _dealt(contents: DataFrame, rows: int, size: int) -> DataFrame:
    """``contents`` in parts small enough that reading them keeps all cores busy: few bytes of mail take long."""
    spark = contents.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return contents.repartition(min(most, 1 + max(size // PART_BYTES, rows // PART_ROWS)), "what.digest")  # by a key of its own, else Spark leaves it out


def _told(level: DataFrame, read: DataFrame, above: list[DataFrame]) -> DataFrame:
    """A level's sources with whether they count, what was read of them, and what they have from their mail."""
    same = lambda case, digest: F.col("case").eqNullSafe(F.col(case)) & (F.col("digest") == F.col(digest))
    fresh = level
    for rows in above:
        had = rows.where("counts").select(F.col("case").alias("_case"), F.col("digest").alias("_digest"))
        fresh = fresh.join(had, same("_case", "_digest"), "left_anti")
    first = fresh.groupBy(F.col("case").alias("_case"), F.col("digest").alias("_digest")).agg(F.min("key").alias("_first"))
    rows = level.join(first, same("_case", "_digest"), "left").withColumn("counts", F.coalesce(F.col("key") == F.col("_first"), F.lit(False))).drop("_case", "_digest", "_first")
    rows = rows.join(read, ["digest", "format"], "left")
    status = F.when(~F.col("counts"), "repeat").when(F.col("error").isNotNull(), "failed").otherwise("parsed")
    mine = lambda c: F.when(F.col("counts"), F.col(c))
    return rows.withColumns({"status": status} | {c: mine(c) for c in ("units", "error", "subject")} | {c: F.coalesce(mine(c), F.col(f"from_{c}")) for c in INHERITED})


def with_language(sources: DataFrame, key: str, model: DataFrame | None = None) -> DataFrame:
    """Sources with code and share of their text's language: by ``model`` (see :mod:`language`), else by frequent words."""
    text = plain.joined_text(F.col("units"))
    if model is None:
        told = W.language(text)
        return sources.withColumns({"code": told["code"], "share": told["share"]})
    texts = sources.where("units is not null").select(F.col(key).alias("_key"), text.alias("_text"))
    found = language.detect(texts.dropDuplicates(["_key"]), model, "_key", "_text")
    return sources.join(found, F.col(key) == F.col("_key"), "left").drop("_key").fillna({"code": language.FALLBACK, "share": 0.0})


def passages(sources: DataFrame, key: str = "path", budget: int = 1800) -> DataFrame:
    """Passages of all parsed sources, each with the sender of its units."""
    return split.passages(sources.where("status = 'parsed'"), key, "units", budget)
