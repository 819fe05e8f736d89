"""Compiled schemas against a plain walk over parsed answers."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from tessera.functions import conformance, schemas

SCHEMAS = {
    "mentions": schemas.mentions(["a point", "b"]),
    "placements": schemas.placements(["s1", "s'2"], "none"),
    "prefilled": schemas.prefilled({"q1": schemas.leaf("number"), "q 2": schemas.leaf("choice", ["x", "y"]), "q3": schemas.leaf("date")}),
    "passage": schemas.passage_answer("boolean"),
    "captions": schemas.captions(2),
    "draft": schemas.draft(schemas.block_value("table", {"id": schemas.leaf("text"), "n": schemas.leaf("number")}, most=3, least=2, material=True)),
    "revision": schemas.revision(schemas.block_value("list")),
    "pattern": schemas.PATTERN, "keywords": schemas.KEYWORDS, "criterion": schemas.CRITERION, "questions": schemas.QUESTIONS, "judgement": schemas.JUDGEMENT,
    "open": schemas.record(False, a="string", b={"type": ["integer", "null"]}),
}
IS = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "null": lambda v: v is None,
}


def plain(value, schema, path="$"):
    kinds = schema.get("type") or []
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(IS[k](value) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"], value
    faults = [f"{path}: not one of the values"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict) and "properties" in schema:
        faults += [f"{path}.{k}: missing" for k in schema["required"] if k not in value]
        kept = {}
        for k, of in schema["properties"].items():
            if k in value:
                more, kept[k] = plain(value[k], of, f"{path}.{k}")
                faults += more
        value = kept | ({} if schema["additionalProperties"] is False else {k: v for k, v in value.items() if k not in kept})
    if isinstance(value, list) and "items" in schema:
        if len(value) < schema.get("minItems", 0):
            faults.append(f"{path}: fewer than {schema['minItems']} entries")
        walked = [plain(v, schema["items"], f"{path}[{i}]") for i, v in enumerate(value[: schema.get("maxItems", len(value))])]
        faults += [f for fs, _ in walked for f in fs]
        value = [v for _, v in walked]
    return faults, value


def made(rng, schema):
    """A value that fits, or nearly."""
    if rng.random() < 0.04:
        return rng.choice([None, 1, 2.5, "text", True, [], {}, ["x"], {"z": 1}])
    kinds = schema.get("type")
    kind = rng.choice(kinds) if isinstance(kinds, list) else kinds
    if "enum" in schema:
        return rng.choice(schema["enum"]) if rng.random() < 0.96 else "other"
    if kind == "object":
        out = {k: made(rng, of) for k, of in schema["properties"].items() if rng.random() < 0.97}
        return out | ({"extra \"'": rng.choice([1, "é\n", [None]])} if rng.random() < 0.2 else {})
    if kind == "array":
        least = schema.get("minItems", 0)
        return [made(rng, schema["items"]) for _ in range(rng.randint(least, max(least, schema.get("maxItems", 3)) + 1) if rng.random() < 0.95 else 0)]
    return {"string": 'a "quoted" \\ 😀\n', "boolean": True, "integer": 12345678901234567890 if rng.random() < 0.1 else 7, "number": rng.choice([1, 2.5, 1e300]), "null": None}[kind]


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_as_a_plain_walk(spark, name):
    rng = random.Random(name)
    values = [made(rng, SCHEMAS[name]) for _ in range(60)]
    raw = [json.dumps(v) for v in values]
    df = spark.createDataFrame(list(enumerate(raw)), "i long, raw string")
    got = sorted(df.select("i", conformance.checked(F.col("raw"), SCHEMAS[name]).alias("c")).collect())
    fine = 0
    for i, c in got:
        faults, kept = plain(values[i], SCHEMAS[name])
        assert c.faults == faults, raw[i]
        if faults:
            assert c.value is None
        else:
            fine += 1
            assert json.loads(c.value) == kept
    assert 0 < fine < 60


def test_odd_texts(spark):
    rows = [None, "", "no json", '{"a": 1', '{"result": "pass", "result": "fail"}', "[]", '{"reason": "r", "confidence": 1}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    got = [r.c for r in df.select("i", conformance.checked(F.col("raw"), schemas.JUDGEMENT).alias("c")).orderBy("i").collect()]
    assert got[0] is None and [c.faults for c in got[1:]] == [["$: not JSON"]] * 4 + [["$: not object"], ["$.result: missing"]]
    got = df.where("i = 6").select(conformance.checked(F.col("raw"), schemas.JUDGEMENT, ("result",)).alias("c")).first().c
    assert got.faults == [] and json.loads(got.value) == {"reason": "r", "confidence": 1}


def test_rows_of_blocks():
    assert schemas.block_value("table", {"a": schemas.leaf("text")}, least=2).get("minItems") is None
    assert schemas.block_value("table", {"a": schemas.leaf("text")}, least=2, material=True)["minItems"] == 2
    assert schemas.block_value("table", {"a": schemas.leaf("text")})["maxItems"] == 12 and schemas.block_value("table", {}, most=3)["maxItems"] == 3
    assert schemas.placements(["a"], "none")["properties"]["assignments"]["maxItems"] == 5
    assert schemas.placements(["a"], "none", 100_000)["properties"]["assignments"]["maxItems"] == 40
