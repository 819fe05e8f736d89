"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The
ledger holds, for each blob and rule version, the findings of the one scan it
had; only pairs that the ledger lacks are scanned, and findings are joined back
to all paths that ever held the blob.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.workspace import keep

SPANS = "array<struct<kind:string,start:long,end:long,rank:int>>"
PART = 256
LEDGER = "blob string, rule_version string, spans " + SPANS


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of a group's text.

    ``guard`` is a pattern that any text with a finding matches; it is cheap.
    """

    kind: str
    pattern: str
    group: int
    at_least: int
    guard: str
    base: bool = False


# The three base kinds, then the kinds that this operator adds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i)(?:passw|secret|token|api_?key)", True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA", True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}", True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1, "eyJ"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, r"gh[pousr]_"),
    Rule("live", r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 1, "k_live_"),
)


def version_of(rules: tuple[Rule, ...]) -> str:
    """Names a rule set by its content."""
    import hashlib

    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches as spans in code points, those too short left out.

    The pieces between matches and the matches themselves alternate, so their
    lengths give the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    items = F.zip_with(F.slice(between, F.lit(1), F.size(found)), F.arrays_zip(found.alias("m"), value.alias("v")), lambda b, m: F.struct(F.char_length(b).cast("long").alias("gap"), F.char_length(m["m"]).cast("long").alias("long"), F.char_length(m["v"]).alias("kept")))
    nothing = F.array().cast(SPANS)

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        span = F.struct(F.lit(rule.kind).alias("kind"), begin.alias("start"), (begin + x["long"]).alias("end"), F.lit(rank).alias("rank"))
        grown = F.when(x["kept"] >= rule.at_least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((begin + x["long"]).alias("at"), grown.cast(SPANS).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("spans"))
    parts = _in_parts(items, lambda part: F.aggregate(part, start, step))
    moved = lambda base, spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + base).alias("start"), (s["end"] + base).alias("end"), s["rank"].alias("rank")))
    placed = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<struct<at:long,spans:{SPANS}>>").alias("parts"))
    after = lambda state, part: F.struct((state["at"] + part["at"]).alias("at"), F.concat(state["parts"], F.array(F.struct(state["at"].alias("at"), part["spans"].alias("spans")))).alias("parts"))
    all_of = F.aggregate(parts, placed, after, lambda s: F.flatten(F.transform(s["parts"], lambda part: moved(part["at"], part["spans"]))))
    return F.when(text.rlike(rule.guard), F.coalesce(all_of, nothing)).otherwise(nothing)


def _in_parts(items: Column, of_part: Callable[[Column], Column]) -> Column:
    """``of_part`` of every PART items, so that what an aggregate rebuilds with each item stays short."""
    first = lambda n: F.sequence(F.lit(0), F.floor((n - 1) / PART).cast("int"))
    each = lambda whole: F.transform(first(F.size(whole)), lambda k: of_part(F.slice(whole, k * PART + 1, F.lit(PART))))
    return F.flatten(F.transform(F.filter(F.array(items), lambda whole: F.size(whole) > 0), each))  # an array of one binds the items, which are computed once


def _all_spans(text: Column, rules: tuple[Rule, ...]) -> Column:
    spans = F.concat(*[spans_of(text, r, i) for i, r in enumerate(rules)])
    key = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    return F.transform(F.array_sort(F.transform(spans, key)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank")))


def scan(history: DataFrame, ledger: DataFrame | None = None, *, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of ``history``, and the ledger's new rows.

    ``history`` has a row for each version of each path. The first result has
    ``path``, blob and spans for each of its rows (kind, start, end and rank, by
    start and then rank); the second has the scans that ``ledger`` lacked, to be
    appended to it. A null text is scanned as empty and has no spans. Rows may
    repeat; a null path is a path. One row is chosen to stand for each unseen
    blob, and rows that repeat path and text are one before it is scanned, so
    texts are shuffled once by path and no blob's copies meet in a task. The scans are written once; only blobs with findings are joined back, in a
    join whose skewed partitions Spark can split.
    """
    version = version_of(rules)
    versions = history.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    versions = versions.withColumns({"blob": F.sha2("content", 256), "at": F.xxhash64("path")})
    blobs = versions.groupBy("blob").agg(F.min("at").alias("at"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == version).select("blob", "spans").dropDuplicates(["blob"])
        blobs = blobs.join(seen, "blob", "left_anti")
    once = versions.select("at", "blob", "content").dropDuplicates(["at", "blob"])
    texts = once.join(blobs.hint("shuffle_hash"), ["at", "blob"], "left_semi")
    # Written before any filter on the spans: one below the semi-join would scan every copy.
    hits = keep(texts.select("blob", _all_spans(F.col("content"), rules).alias("spans")), "ledger-scans")
    known = hits if ledger is None else hits.unionByName(seen)
    found = versions.select("path", "blob").join(known.where(F.size("spans") > 0), "blob", "left")
    found = found.select(F.col("path").alias(path), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    fresh = hits.select("blob", F.lit(version).alias("rule_version"), "spans")
    return found, fresh


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every span replaced; of overlapping spans only what the first leaves is cut.

    Spans are taken PART at a time with the stretch of the text that they lie in.
    """
    furthest = lambda part: F.array_max(F.transform(part, lambda s: s["end"]))
    none = F.array().cast(f"array<struct<base:long,upto:long,spans:{SPANS}>>")

    def after(state: Column, part: Column) -> Column:
        upto = F.greatest(state["at"], furthest(part))
        return F.struct(upto.alias("at"), F.concat(state["parts"], F.array(F.struct(state["at"].alias("base"), upto.alias("upto"), part.alias("spans")))).alias("parts"))

    def cut(part: Column) -> Column:
        within = F.substring(text, (part["base"] + 1).cast("int"), (part["upto"] - part["base"]).cast("int"))
        return F.element_at(F.transform(F.array(within), lambda stretch: replaced(stretch, part)), 1)

    def replaced(stretch: Column, part: Column) -> Column:
        def step(state: Column, s: Column) -> Column:
            apart = F.substring(stretch, (state["at"] - part["base"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
            out = F.when(s["start"] >= state["at"], F.concat(state["out"], apart, F.lit(mark))).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

        return F.aggregate(part["spans"], F.struct(part["base"].alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])

    parts = F.aggregate(_in_parts(spans, lambda part: part), F.struct(F.lit(0).cast("long").alias("at"), none.alias("parts")), after, lambda s: s["parts"])
    rest = F.substring(text, (furthest(spans) + 1).cast("int"), F.char_length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(parts, cut), ""), rest)).otherwise(text)
