"""The quality gate and what is derived from checks: reports, section status, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.checks import blocks_export
from tessera.operators.history import latest


def gate_report(live: DataFrame, declared: DataFrame, stored: DataFrame, document: str = "document") -> DataFrame:
    """One row per document: blockers, warnings, passes, unevaluated checks, and whether the gate lets it pass.

    ``live`` has the results of rules, computed now: document, requirement,
    severity, outcome. ``declared`` has the judged checks that must have a result
    (document, requirement, severity), ``stored`` what assessments found (also
    assessed_at); the latest counts. Warnings never block.
    """
    last = latest(stored.select(document, "requirement", "assessed_at", "outcome"), [document, "requirement"], [F.col("assessed_at"), F.col("outcome")])
    judged = declared.select(document, "requirement", "severity").join(last.select(document, "requirement", "outcome"), [document, "requirement"], "left")
    every = live.select(document, "requirement", "severity", "outcome").unionByName(judged)
    bad = F.col("outcome").isin("fail", "error")
    counts = every.groupBy(document).agg(
        F.count_if(F.coalesce(blocks_export(F.col("severity"), F.col("outcome")), F.lit(False))).alias("blockers"),
        F.count_if(F.coalesce(bad & (F.col("severity") != "blocker"), F.lit(False))).alias("warnings"),
        F.count_if(F.coalesce(F.col("outcome") == "pass", F.lit(False))).alias("passes"),
        F.count_if(F.col("outcome").isNull()).alias("not_evaluated"),
    )
    return counts.withColumn("passed", (F.col("blockers") == 0) & (F.col("not_evaluated") == 0))


def report_lines(results: DataFrame, document: str = "document") -> DataFrame:
    """The report as text: blockers, warnings, passes, then what has no result."""
    rank = F.when(F.col("outcome").isNull(), 3).when(blocks_export(F.col("severity"), F.col("outcome")), 0).when(F.col("outcome").isin("fail", "error"), 1).otherwise(2)
    mark = F.element_at(F.array(*[F.lit(x) for x in ("BLOCKER", "WARNING", "PASS", "PENDING")]), rank + 1)
    line = F.concat_ws(" ", mark, F.col("requirement"), F.coalesce("reason", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.col("requirement").alias("requirement"), F.rtrim(line).alias("line"))))
    return results.groupBy(document).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("report"))


def export_allowed(passed: Column, reason: Column) -> Column:
    """Passed, or overridden with a reason that says something."""
    return passed | F.coalesce(F.btrim(reason) != "", F.lit(False))


def section_status(stale: Column, completed: Column, n_blockers: Column, has_content: Column, n_missing: Column, n_waiting: Column | None = None) -> Column:
    """The status that wins: stale, complete (no blocker fails), blocked (it waits for others), empty, needs_input, drafted."""
    return (
        F.when(stale, "stale")
        .when(completed & (n_blockers == 0), "complete")
        .when(F.lit(False) if n_waiting is None else n_waiting > 0, "blocked")
        .when(~has_content, "empty")
        .when((n_missing > 0) | (n_blockers > 0), "needs_input")
        .otherwise("drafted")
    )


def progress(questions: DataFrame, answers: DataFrame, section: str = "section", question: str = "question") -> DataFrame:
    """Per section: questions, answered, unconfirmed, percent (rounded half to even) and whether all are answered."""
    given = answers.select(section, question, "source", "value")
    return progress_of(questions.select(section, question).join(given, [section, question], "left"), section)


def progress_of(asked: DataFrame, section: str = "section") -> DataFrame:
    """The same of questions that have the source and value of their answer beside them, null for none."""
    said = F.btrim(F.coalesce("value", F.lit(""))) != ""
    proposed = F.coalesce(F.col("source") == "proposed", F.lit(False))
    sums = asked.groupBy(section).agg(F.count("*").alias("questions"), F.count_if(said & ~proposed).alias("answered"), F.count_if(said & proposed).alias("unconfirmed"))
    return sums.withColumns({"percent": F.bround(100 * F.col("answered") / F.col("questions")).cast("long"), "done": F.col("answered") == F.col("questions")})


def resume_at(steps: DataFrame, document: str = "document") -> DataFrame:
    """Where a guided document goes on, and whether it is completed: at the check when complete, at the first waiting question, else at writing."""
    waiting = F.min(F.when(F.col("waiting"), F.struct("position", "question")))
    at = steps.groupBy(document).agg(F.bool_and("completed").alias("completed"), waiting.alias("_next"))
    where = F.when(F.col("completed"), "check").when(F.col("_next").isNotNull(), F.concat(F.lit("question:"), F.col("_next.question"))).otherwise("write")
    return at.select(document, where.alias("step"), "completed")


def assessed(stored: DataFrame, results: DataFrame, run: Column, at: Column) -> DataFrame:
    """Stored assessments with a run's results behind them: run, assessed_at, and the species of check that found each.

    What a rule or a judge says of a requirement is kept beside what it said
    before; :func:`gate_report` reads the latest.
    """
    new = results.withColumns({"run": run, "assessed_at": at})
    return stored.unionByName(new.select(*stored.columns))


def export_records(exports: DataFrame, reports: DataFrame, document: str = "document") -> DataFrame:
    """Exports with ``state`` (exported or blocked) and ``gate``, the document's report at that time as JSON.

    A document whose gate has not passed, or that has no report, is blocked
    unless a reason is given; the reason is kept only where it was needed.
    """
    told = reports.select(document, "passed", F.to_json(F.struct(*[c for c in reports.columns if c != document])).alias("gate"))
    rows = exports.join(told, document, "left")
    passed = F.coalesce("passed", F.lit(False))
    state = F.when(export_allowed(passed, F.col("reason")), "exported").otherwise("blocked")
    return rows.withColumn("state", state).withColumn("reason", F.when(~passed & (F.col("state") == "exported"), F.btrim("reason"))).drop("passed")
