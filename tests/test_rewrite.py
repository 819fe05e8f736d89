"""Renames and deletions in nested specifications against a plain rewriting of dicts."""

from __future__ import annotations

import copy
import random

from pyspark.sql import functions as F
from tessera.operators import rewrite

SCHEMA = (
    "spec string, title string, sections array<struct<key:string,depends_on:array<string>,blocks:array<struct<key:string,kind:string,columns:array<struct<key:string>>>>,"
    "requirements:array<struct<id:string,block:string,field:string,fields:array<string>,references:string>>>>, criteria array<struct<id:string,scope:array<string>>>"
)
CHANGES = "spec string, seq int, path array<string>, new string"


def made(rng, name):
    keys = ["a", "b", "c", "a_2"]
    pick = lambda: ".".join(rng.choice(keys) for _ in range(rng.choice([3, 3, 3, 2])))
    section = lambda k: {
        "key": k,
        "depends_on": rng.sample(keys, 2),
        "blocks": [{"key": b, "kind": "table", "columns": [{"key": c} for c in rng.sample(keys, 3)]} for b in rng.sample(keys, 3)],
        "requirements": [{"id": f"r{i}", "block": rng.choice([*keys, None]), "field": rng.choice([*keys, None]), "fields": rng.choice([None, rng.sample(keys, 2)]), "references": rng.choice([None, pick()])} for i in range(4)],
    }
    return {"spec": name, "title": "t", "sections": [section(k) for k in rng.sample(keys, 3)], "criteria": [{"id": "q", "scope": rng.sample(keys, 2)}, {"id": "p", "scope": None}]}


def free(new, old, items):
    taken = {x["key"] for x in items if x["key"] != old}
    return next(k for k in [new] + [f"{new}_{n}" for n in range(2, 21)] if k not in taken)


def put(items, old, new):
    return [{**x, "key": new if x["key"] == old else x["key"]} for x in items if new is not None or x["key"] != old]


def named(items, old, new):
    return None if items is None else [new if k == old else k for k in items if not (k == old and new is None)]


def plain(spec, path, new):
    spec = copy.deepcopy(spec)
    own = [s for s in spec["sections"] if s["key"] == path[0]]
    depth = len(path)
    there = own and (depth < 2 or any(b["key"] == path[1] and (depth < 3 or any(c["key"] == path[2] for c in b["columns"])) for b in own[0]["blocks"]))
    if not there:
        return spec
    if depth == 1:
        new = new and free(new, path[0], spec["sections"])
        spec["sections"] = put(spec["sections"], path[0], new)
        for s in spec["sections"]:
            s["depends_on"] = named(s["depends_on"], path[0], new)
        for c in spec["criteria"]:
            c["scope"] = named(c["scope"], path[0], new)
    elif depth == 2:
        new = new and free(new, path[1], own[0]["blocks"] if own else [])
        for s in own:
            s["blocks"] = put(s["blocks"], path[1], new)
            s["requirements"] = [{**r, "block": new if r["block"] == path[1] else r["block"]} for r in s["requirements"] if new is not None or r["block"] != path[1]]
    else:
        blocks = [b for s in own for b in s["blocks"] if b["key"] == path[1]]
        new = new and free(new, path[2], blocks[0]["columns"] if blocks else [])
        for b in blocks:
            b["columns"] = put(b["columns"], path[2], new)
        for s in own:
            for r in s["requirements"]:
                if r["block"] == path[1]:
                    r["field"] = new if r["field"] == path[2] else r["field"]
                    r["fields"] = named(r["fields"], path[2], new)
    if new is not None:
        for s in spec["sections"]:
            for r in s["requirements"]:
                parts = (r["references"] or "").split(".")
                if len(parts) == 3 and parts[:depth] == path:
                    r["references"] = ".".join([*parts[: depth - 1], new, *parts[depth:]])
    return spec


def test_as_plain_rewriting(spark):
    rng = random.Random(21)
    specs = [made(rng, f"s{i}") for i in range(60)]
    changes, want = [], {}
    for spec in specs:
        now = spec
        for seq in range(rng.choice([0, 1, 3])):
            path = [rng.choice(["a", "b", "c", "gone"]) for _ in range(rng.choice([1, 2, 3]))]
            new = rng.choice([None, "new", "b", "a_2"])
            changes.append((spec["spec"], seq, path, new))
            now = plain(now, path, new)
        want[spec["spec"]] = now
    rng.shuffle(changes)
    got = rewrite.rewritten(spark.createDataFrame(specs, SCHEMA), spark.createDataFrame(changes, CHANGES))
    assert got.columns == ["spec", "title", "sections", "criteria"]
    for r in got.collect():
        assert r.asDict(True) == want[r.spec], r.spec


def test_nothing_to_change(spark):
    specs = spark.createDataFrame([("s", "t", [], []), ("n", "t", None, None)], SCHEMA)
    changes = spark.createDataFrame([("s", 0, ["a"], "b"), ("n", 0, ["a", "b"], None), ("x", 0, ["a"], None)], CHANGES)
    assert {r.spec: (r.sections, r.criteria) for r in rewrite.rewritten(specs, changes).collect()} == {"s": ([], []), "n": (None, None)}


def test_query_works_each_specification_out_once(spark):
    """No test of the array that is exploded repeats the fold, and a new name is sought once, not for every key."""
    from tessera.plans.registry import QUERIES

    plan = QUERIES["rewritten_specs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate(coalesce(") == 1
    state = F.struct(F.array(F.struct(F.lit("a").alias("key"), F.array("k").alias("depends_on"), F.array().cast("array<struct<references:string>>").alias("requirements"))).alias("sections"), F.array().cast("array<struct<scope:array<string>>>").alias("criteria"))
    made = spark.createDataFrame([("a", "b")], "k string, n string").select(rewrite._of_section(state, F.array("k"), F.col("n")))
    assert made._jdf.queryExecution().analyzed().toString().count("sequence(") <= 2  # shown twice, sought once
