"""What plans of queries carry and read, told from the optimised plan."""

from __future__ import annotations

from tessera.plans import registry

FOLDER = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_guided_resume_joins_once(spark):
    assert _plan(registry.QUERIES["guided_resume"](spark, FOLDER)).count("Join ") == 1


def test_placements_are_checked_before_the_join(spark):
    """Texts are not carried through the join with the sections."""
    above, join, below = _plan(registry.QUERIES["placements_checked"](spark, FOLDER)).partition("Join ")
    assert join and "text#" not in above and "text#" in below


def test_evaluated_reads_each_table_twice(spark):
    """Once for what is asked of blocks and once for their contents, however many rules there are."""
    plan = _plan(registry.QUERIES["evaluated"](spark, FOLDER))
    assert plan.count("n_chars#") <= 2 and plan.count("l_orderkey#") > 0
    assert sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines()) == 2
