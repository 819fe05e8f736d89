"""Sections of documents as a fold over what was done to them: completions, reopenings, staleness, edits.

What is kept of a log is, for each section, the last event that says whether it
is complete and the last that says whether it is stale. Both are maxima, so parts
of a log may be folded in any number and order, in a batch or as a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import gate

# What events say of completion and of staleness; others say nothing.
COMPLETES = {"complete": True, "reopen": False}
STALES = {"complete": False, "reopen": False, "mark_stale": True, "clear_stale": False}


def _says(kind: Column, what: dict[str, bool]) -> Column:
    """true, false or null: what an event of a kind says."""
    return F.create_map(*[x for k, v in what.items() for x in (F.lit(k), F.lit(v))])[kind]


def folded(log: DataFrame, by: Sequence[str], kind: str, order: Sequence[str]) -> DataFrame:
    """``by``, last_completed, last_stale, n_edits: what is kept of a log; also of a stream, as an aggregate.

    ``order`` tells events of one section apart. Events of unknown kinds count for nothing.
    """
    last = lambda what: F.max(F.when(_says(F.col(kind), what).isNotNull(), F.struct(*order, _says(F.col(kind), what).alias("says"))))
    return log.groupBy(*by).agg(last(COMPLETES).alias("last_completed"), last(STALES).alias("last_stale"), F.count_if(F.col(kind) == "edit").alias("n_edits"))


def merged(kept: DataFrame, more: DataFrame, by: Sequence[str]) -> DataFrame:
    """What is kept of two parts of a log as one."""
    both = kept.unionByName(more).groupBy(*by)
    return both.agg(F.max("last_completed").alias("last_completed"), F.max("last_stale").alias("last_stale"), F.sum("n_edits").alias("n_edits"))


def facts(kept: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, completed, stale, n_edits."""
    return kept.select(*by, F.coalesce("last_completed.says", F.lit(False)).alias("completed"), F.coalesce("last_stale.says", F.lit(False)).alias("stale"), "n_edits")


def missing_answers(questions: DataFrame, answers: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by`` and question of required questions that nobody answered: blank, absent, or proposed and not confirmed."""
    given = answers.where((F.btrim(F.coalesce("value", F.lit(""))) != "") & (F.col("source") != "proposed")).select(*by, "question").distinct()
    return questions.where("required").select(*by, "question").distinct().join(given, [*by, "question"], "left_anti")


def section_states(sections: DataFrame, needs: DataFrame, known: DataFrame, content: DataFrame, missing: DataFrame, results: DataFrame, document: str = "document", section: str = "section") -> DataFrame:
    """One row per section: status, blocked_by, missing, failures, blockers, can_draft, can_complete.

    ``needs`` has depends_on, ``known`` completed and stale (see :func:`facts`),
    ``content`` the sections with any content or answer, ``missing`` question,
    ``results`` requirement, severity and outcome. Lists are sorted. A section
    can be drafted when nothing that it needs is open and no required answer is
    missing; it can be completed when no blocker fails and it is neither blocked
    nor empty. A need that is no section of the document is never met.
    """
    by = [document, section]
    told = known.select(*by, "completed", "stale")
    done = told.where("completed").select(document, F.col(section).alias("depends_on"))
    listed = lambda rows, what, name: rows.groupBy(*by).agg(F.array_sort(F.collect_set(what)).alias(name))
    open_needs = listed(needs.join(done, [document, "depends_on"], "left_anti"), "depends_on", "blocked_by")
    failed = results.where(F.col("outcome").isin("fail", "error"))
    rows = sections.join(told, by, "left").join(content.select(*by).distinct().withColumn("_has", F.lit(True)), by, "left")
    parts = [open_needs, listed(missing, "question", "missing"), listed(failed, "requirement", "failures"), listed(failed.where("severity = 'blocker'"), "requirement", "blockers")]
    for part in parts:
        rows = rows.join(part, by, "left")
        name = part.columns[-1]
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    status = gate.section_status(yes(F.col("stale")), yes(F.col("completed")), F.size("blockers"), yes(F.col("_has")), F.size("missing"), F.size("blocked_by"))
    rows = rows.withColumn("status", status)
    can_draft = (F.size("blocked_by") == 0) & (F.size("missing") == 0)
    can_complete = (F.size("blockers") == 0) & ~F.col("status").isin("blocked", "empty")
    return rows.select(*sections.columns, "status", "blocked_by", "missing", "failures", "blockers", can_draft.alias("can_draft"), can_complete.alias("can_complete"))


def told_of_edits(log: DataFrame, dependents: DataFrame, by: Sequence[str], kind: str, order: Sequence[str]) -> DataFrame:
    """Edits of sections that were complete when they were edited, with what rests on those: ``by``, ``order``, dependents.

    ``dependents`` has all but the last of ``by``, source, target and position: source
    rests on target, directly or not; they are listed by position. Nothing becomes
    stale by itself. A section's own log is read in order.
    """
    *within, section = by
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    was = F.last(_says(F.col(kind), COMPLETES), ignorenulls=True).over(before)
    edits = log.withColumn("_was", was).where((F.col(kind) == "edit") & F.col("_was")).select(*by, *order)
    lists = dependents.groupBy(*within, F.col("target").alias(section)).agg(F.transform(F.array_sort(F.collect_set(F.struct("position", "source"))), lambda x: x["source"]).alias("dependents"))
    kind_of = lists.schema["dependents"].dataType
    return edits.join(lists, list(by), "left").withColumn("dependents", F.coalesce("dependents", F.array().cast(kind_of)))
