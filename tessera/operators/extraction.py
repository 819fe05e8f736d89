"""From hits to findings: acceptance, merging, re-runs, decisions, funnels, reports.

A hit is a row: question, command, tier (0 pattern, 1 keyword and ask, 2 ask),
score, source, where, ord (document order), value, quote. Order has a meaning
everywhere, so it is a column and never the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

OUTCOMES = ("found", "not_stated", "quote_rejected", "type_rejected", "error", "not_read")


def plan(commands: DataFrame, hit_counts: DataFrame, scanned: int | Column, top_k: int = 6) -> DataFrame:
    """What a run would do per command: passages scanned, hit, and asked about, without running it."""
    n = F.lit(scanned) if isinstance(scanned, int) else scanned
    joined = commands.join(hit_counts, "command", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    hit = F.when(F.col("kind") == "ask", n).otherwise(F.col("hit"))
    asked = F.when(F.col("kind") == "pattern", F.lit(0)).otherwise(F.least(hit, F.lit(top_k)))
    return joined.select("command", "kind", n.cast("long").alias("scanned"), hit.cast("long").alias("hit"), asked.cast("long").alias("asked"))


def outcome(stated: Column, quote_ok: Column, fits: Column, error: Column) -> Column:
    """What became of one answered passage."""
    return F.when(error, "error").when(~stated, "not_stated").when(~quote_ok, "quote_rejected").when(~fits, "type_rejected").otherwise("found")


def candidates(hits: DataFrame, *, occurrences: bool = True) -> DataFrame:
    """One row for each question and key: the best hit's value, and how often and where it was found.

    The best hit has the first tier, then the highest score, then comes first in
    the document. A pattern's score is its number of hits. Occurrences are
    distinct by source, place and quote, in document order. All of it is one
    aggregate, whose partial sums run before the shuffle.
    """
    best = F.min_by(F.struct("value", "tier", "source", "score"), F.struct("tier", (-F.col("score")).alias("s"), "ord"))
    found = [
        best.alias("_best"),
        F.count("*").alias("hits"),
        F.count_if(F.col("tier") == 0).alias("_pattern_hits"),
        F.count_distinct("source").alias("places"),
    ]
    if occurrences:
        found.append(F.collect_set(F.struct("source", "where", "quote")).alias("_seen"))
    out = hits.where("key <> ''").groupBy("question", "key").agg(*found)
    score = F.when(F.col("_best.tier") == 0, F.col("_pattern_hits").cast("double")).otherwise(F.col("_best.score"))
    columns = ["question", "key", F.col("_best.value").alias("value"), F.col("_best.tier").alias("tier"), score.alias("score"), "hits", "places"]
    return out.select(*columns, *([F.array_sort("_seen").alias("occurrences")] if occurrences else []))


def n_merged(found: DataFrame) -> DataFrame:
    """Per question: how many hits became part of another finding."""
    return found.groupBy("question").agg(F.sum(F.col("hits") - 1).alias("merged"))


def rerun(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings after another run.

    Decided ones stay with their decision and only get their hits anew; pending
    ones are replaced; pending ones that were not found again go.
    """
    a = old.select("question", "key", F.struct("value", "hits", "status").alias("_old"))
    b = new.select("question", "key", F.struct("value", "hits").alias("_new"))
    decided = F.col("_old.status").isin("accepted", "dismissed")
    both = a.join(b, ["question", "key"], "full").where(F.col("_new").isNotNull() | decided)
    return both.select(
        "question",
        "key",
        F.when(decided, F.col("_old.value")).otherwise(F.col("_new.value")).alias("value"),
        F.coalesce("_new.hits", "_old.hits").alias("hits"),
        F.when(decided, F.col("_old.status")).otherwise("pending").alias("status"),
    )


def decide(decisions: DataFrame, questions: DataFrame) -> DataFrame:
    """The state of every finding: where a question takes one answer, only the one accepted last stays accepted."""
    joined = decisions.join(questions.select("question", "multiple"), "question")
    accepted = F.col("status") == "accepted"
    last = F.max_by(F.when(accepted, F.col("key")), F.when(accepted, F.struct("decided_at", "key"))).over(Window.partitionBy("question"))
    return joined.withColumn("status", F.when(accepted & ~F.col("multiple") & (F.col("key") != last), "pending").otherwise(F.col("status"))).drop("multiple")


def funnel(steps: DataFrame, by: list[str]) -> DataFrame:
    """Counts of every outcome; asked is the sum of those that were read."""
    counts = steps.groupBy(*by).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    return counts.withColumn("asked", sum((F.col(o) for o in OUTCOMES[:5]), F.lit(0)))


def review(found: DataFrame) -> DataFrame:
    """Per question: pending, shown and dismissed findings, and whether it is settled."""
    counts = found.groupBy("question").agg(
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") != "dismissed").alias("shown"),
        F.count_if(F.col("status") == "dismissed").alias("dismissed"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
    )
    return counts.withColumn("settled", (F.col("pending") == 0) & (F.col("accepted") > 0))


def passed_over(steps: DataFrame, most: int = 20) -> DataFrame:
    """Passages of the latest run in which no step of the question found anything: those read by rank, then the others."""
    run = Window.partitionBy("question")
    last = steps.withColumn("_last", F.max("run").over(run)).where(F.col("run") == F.col("_last")).drop("_last")
    found = last.where("outcome = 'found'").select("question", "passage").distinct()
    unread = F.col("outcome") == "not_read"
    left = last.join(found, ["question", "passage"], "left_anti")
    one = left.groupBy("question", "passage").agg(F.min(F.struct(unread.alias("unread"), "rank", "outcome")).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("question").orderBy("_first.unread", "_first.rank", "passage"))
    return one.select("question", "passage", "_first.outcome", "_first.rank", nth.alias("place")).where(F.col("place") <= most)


def orphaned(accepted: DataFrame, commands: DataFrame) -> DataFrame:
    """Accepted findings that no command of their question would find now: its tier is gone, or no pattern matches them."""
    tiers = commands.select("question", "tier").distinct()
    gone = accepted.join(tiers, ["question", "tier"], "left_anti")
    patterns = commands.where("tier = 0").select(F.col("question").alias("_q"), "pattern")
    here = accepted.join(tiers, ["question", "tier"], "left_semi").where("tier = 0")
    stray = here.join(patterns, (F.col("question") == F.col("_q")) & F.expr("value rlike pattern"), "left_anti")
    return gone.unionByName(stray)


def loaded(existing: DataFrame, saved: DataFrame, by: str, key: str, seq: str) -> DataFrame:
    """A saved question set behind a case's questions; keys that the case has are passed over."""
    from tessera.operators.history import appended

    fresh = saved.join(existing.select(by, key), [by, key], "left_anti")
    return appended(existing, fresh, [by], [F.col(seq)], seq)


def findings_report(found: DataFrame) -> DataFrame:
    """Per question a Markdown section: values by shared passage, passages in order of their first value."""
    line = F.concat(F.lit("- **"), F.array_join(F.array_sort(F.collect_set("value")), ", "), F.lit("** — "), T.collapse("quote"))
    by_quote = found.groupBy("question", "quote").agg(F.min("ord").alias("ord"), line.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("ord", "line")))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return by_quote.groupBy("question").agg(F.concat(F.lit("## "), F.col("question"), F.lit("\n\n"), body).alias("markdown"))


def findings_json(found: DataFrame) -> DataFrame:
    """Per question a JSON array of passages in order of their first value: quote, and its values sorted, each once."""
    values = F.array_sort(F.collect_set("value")).alias("values")
    by_quote = found.groupBy("question", T.collapse("quote").alias("quote")).agg(F.min("ord").alias("ord"), values)
    rows = F.array_sort(F.collect_list(F.struct("ord", "quote", "values")))
    return by_quote.groupBy("question").agg(F.to_json(F.transform(rows, lambda x: F.struct(x["quote"].alias("quote"), x["values"].alias("values")))).alias("json"))


def run_rows(steps: DataFrame, run: str = "run") -> DataFrame:
    """What a run came to: ``run``, sources, passages, calls, errors, found, seconds.

    ``steps`` has a row for each passage that a command looked at: source,
    passage, tier (2 asks a model), outcome, began and ended. Null outcomes are
    steps that were not made.
    """
    made = steps.where("outcome is not null")
    last, first = F.max("ended").cast("timestamp"), F.min("began").cast("timestamp")
    return made.groupBy(run).agg(
        F.count_distinct("source").alias("sources"),
        F.count_distinct("passage").alias("passages"),
        F.count_if(F.col("tier") == 2).alias("calls"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("outcome") == "found").alias("found"),
        (F.unix_micros(last) - F.unix_micros(first)).alias("micros"),
    ).withColumn("seconds", F.round(F.col("micros") / 1_000_000, 3)).drop("micros")
