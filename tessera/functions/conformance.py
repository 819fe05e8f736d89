"""JSON schemas compiled to one expression: what is wrong with an answer, where, and what is kept of it.

A schema is a dict with type, properties, required, additionalProperties, items,
minItems, maxItems and enum; any other entry says nothing here. The expression
reads a variant, so nothing leaves the JVM.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

Schema = dict

# The names that schemas use for what a variant says it is.
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "BIGINT": "integer", "VOID": "null"}
_NONE = "array<string>"


def kind_of(v: Column) -> Column:
    """object, array, string, boolean, integer, number or null."""
    told = F.schema_of_variant(v)
    named = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.regexp_extract(told, "^[A-Z]+", 0)]
    return F.coalesce(named, F.when(told.rlike(r",0\)$"), "integer").otherwise("number"))


def _quoted(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$[{_quoted(key)}]", "variant")


def _when(fault: Column, path: Column, what: str) -> Column:
    said = F.concat(path, F.lit(": " + what))
    return F.when(fault, F.array(said)).otherwise(F.array().cast(_NONE))


def _bound(v: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(v), use)[0]


def _walk(v: Column, schema: Schema, path: Column, optional: tuple[str, ...] = ()) -> Column:
    """faults and json of a variant; json is only to be used where there are no faults."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    kind = kind_of(v)
    fits = kind.isin(*kinds, *(["integer"] if "number" in kinds else [])) if kinds else F.lit(True)
    faults = [_when((kind != "string") | ~F.try_variant_get(v, "$", "string").isin(*schema["enum"]), path, "not one of the values")] if "enum" in schema else []
    text = F.to_json(v)
    if "properties" in schema:
        faults.append(F.when(kind == "object", F.flatten(F.array(*_members(v, schema, path, optional)))).otherwise(F.array().cast(_NONE)))
        text = F.when(kind == "object", _kept(v, schema, path)).otherwise(text)
    if "items" in schema or "minItems" in schema:
        cells = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        if "minItems" in schema:
            faults.append(_when((kind == "array") & (F.size(cells) < schema["minItems"]), path, f"fewer than {schema['minItems']} entries"))
        cells = F.slice(cells, 1, schema["maxItems"]) if "maxItems" in schema else cells
        entry = lambda x, i: _walk(x, schema.get("items", {}), F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        walked = F.transform(cells, entry)
        faults.append(F.when(kind == "array", F.flatten(F.transform(walked, lambda w: w["faults"]))).otherwise(F.array().cast(_NONE)))
        text = F.when(kind == "array", F.concat(F.lit("["), F.array_join(F.transform(walked, lambda w: w["json"]), ","), F.lit("]"))).otherwise(text)
    every = F.concat(*faults) if faults else F.array().cast(_NONE)
    return F.struct(F.when(fits, every).otherwise(F.array(F.concat(path, F.lit(f": not {' or '.join(kinds or [])}")))).alias("faults"), text.alias("json"))


def _members(v: Column, schema: Schema, path: Column, optional: tuple[str, ...]) -> list[Column]:
    missing = [_when(_member(v, k).isNull(), F.concat(path, F.lit(f".{k}")), "missing") for k in schema.get("required", []) if k not in optional]

    def inside(key: str, of: Schema) -> Column:
        own = F.concat(path, F.lit(f".{key}"))
        return _bound(_member(v, key), lambda x: F.when(x.isNull(), F.array().cast(_NONE)).otherwise(_walk(x, of, own)["faults"]))

    return missing + [inside(key, of) for key, of in schema["properties"].items()]


def _kept(v: Column, schema: Schema, path: Column) -> Column:
    """An object's declared members, and the others unless they are forbidden."""

    def member(key: str, of: Schema) -> Column:
        name = json.dumps(key, ensure_ascii=False) + ":"
        return _bound(_member(v, key), lambda x: F.when(x.isNotNull(), F.concat(F.lit(name), _walk(x, of, path)["json"])))

    parts = [member(key, of) for key, of in schema["properties"].items()]
    if schema.get("additionalProperties", True) is not False:
        others = F.map_filter(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, _: ~k.isin(*schema["properties"]))
        said = F.transform(F.map_entries(others), lambda e: F.concat(F.to_json(F.to_variant_object(F.struct(e["key"].alias("k")))), F.to_json(e["value"])))
        parts.append(F.nullif(F.array_join(F.transform(said, lambda s: F.concat(F.regexp_extract(s, r'(?s)^\{"k":("(?:[^"\\]|\\.)*")\}', 1), F.lit(":"), F.regexp_replace(s, r'(?s)^\{"k":"(?:[^"\\]|\\.)*"\}', ""))), ","), F.lit("")))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def checked(raw: Column, schema: Schema, optional: tuple[str, ...] = ()) -> Column:
    """``faults`` and ``value`` of an answer given as text.

    ``faults`` has one entry for each violation, its path first (``$.points[2].quote:
    missing``); of a value that is of the wrong type nothing below is looked at.
    ``value`` is the answer as JSON with undeclared members dropped where they
    are forbidden and arrays cut to ``maxItems``, what is cut off not looked at;
    null where there are faults. Text that is no JSON, or repeats a member, has
    the fault ``$: not JSON``; null text has null for both. ``optional`` names
    members of the root that may be missing.
    """
    walked = lambda v: F.when(v.isNull(), F.struct(F.array(F.lit("$: not JSON")).alias("faults"), F.lit(None).cast("string").alias("json"))).otherwise(_walk(v, schema, F.lit("$"), optional))
    told = _bound(F.try_parse_json(raw), walked)
    return F.when(raw.isNotNull(), _bound(told, lambda w: F.struct(w["faults"].alias("faults"), F.when(F.size(w["faults"]) == 0, w["json"]).alias("value"))))
