"""URL rules by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the expressions that a rule fitting it could have:
each suffix of its host with as many labels as some rule's host, with each
prefix of its path as long as some rule's path. Expressions meet rules in an equi-join on the first four bytes of
their SHA-256, and the whole digest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8
EMPTY_PARTS = 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expressions(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    labels = F.split(host, r"\.")
    deep = F.filter(F.array(*[F.lit(n) for n in depths]), lambda n: n <= F.size(labels))
    hosts = F.transform(deep, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length(path))
    paths = F.transform(fits, lambda n: F.substring(path, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", broadcast_rows: int = 100_000) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules`` has host, path and verdict (null rows in it are left out). A rule
    fits its host and all subdomains where the URL's path starts with the rule's;
    the longest wins, and between rules of one text the first verdict by name.
    URLs that no rule fits, null ones and ones without ``://`` get ``default`` and
    a null rule. Each distinct URL is expanded once, so repeated URLs cost
    nothing more, and pages with the same URL get the same verdict. Columns of
    these names in ``pages`` are replaced; the others stay, whatever their names.
    Path lengths and numbers of labels are a property of the rules alone. URLs
    without host and path, which may be many, are dealt over ``EMPTY_PARTS``
    parts; rules are broadcast only when counted to be
    at most ``broadcast_rows``, else shuffled.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null")
    depths = sorted(r[0] for r in rules.select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect())
    rules = rules.groupBy(F.concat("host", "path").alias("rule"), F.char_length("path").alias("length")).agg(F.min("verdict").alias("verdict"))
    lengths = sorted(r[0] for r in rules.select("length").distinct().collect())
    named = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop("rule", "verdict")
    if not lengths:
        return named.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    digests = rules.select("rule", "verdict", F.sha2("rule", 256).alias("full")).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    if digests.limit(broadcast_rows + 1).count() <= broadcast_rows:
        digests = F.broadcast(digests)
    urls = named.select("host", "path").distinct()
    expanded = (
        urls.select("host", "path", F.explode(_expressions(F.col("host"), F.col("path"), depths, lengths)).alias("expression"))
        .withColumn("url_full", F.sha2("expression", 256))
        .withColumn("short", F.substring("url_full", 1, PREFIX_HEX))
    )
    won, part = _free("won", pages), _free("part", pages)
    best = expanded.join(digests, "short").where("url_full = full")
    best = best.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.char_length("rule"), "rule")).alias(won))
    empty = (F.col("host") == "") & (F.col("path") == "")
    parts = F.when(empty, F.sequence(F.lit(0), F.lit(EMPTY_PARTS - 1))).otherwise(F.array(F.lit(0)))
    best = best.withColumn(part, F.explode(parts))
    dealt = named.withColumn(part, F.when(empty, F.pmod(F.monotonically_increasing_id(), F.lit(EMPTY_PARTS))).otherwise(0).cast("int"))
    judged = dealt.join(best, ["host", "path", part], "left")
    return judged.withColumns({"rule": F.col(won)["rule"], "verdict": F.coalesce(F.col(won)["verdict"], F.lit(default))}).drop(won, part)


def _free(name: str, taken: DataFrame) -> str:
    """``name``, or with underscores a name that no column has."""
    while name.lower() in {c.lower() for c in taken.columns}:
        name += "_"
    return name
