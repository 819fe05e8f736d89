"""The schemas of answers, as data for :mod:`conformance`."""

from __future__ import annotations

from tessera.functions.conformance import Schema

CEILING = 12
MOST_PLACED = 40


def record(closed: bool = True, **members: Schema | str) -> Schema:
    """An object that needs all its members and, if closed, may have no others."""
    properties = {k: {"type": v} if isinstance(v, str) else v for k, v in members.items()}
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": not closed}


def many(of: Schema | str, most: int | None = None, least: int | None = None) -> Schema:
    bounds = {"maxItems": most, "minItems": least}
    return {"type": "array", "items": {"type": of} if isinstance(of, str) else of} | {k: v for k, v in bounds.items() if v is not None}


def one_of(*values: str) -> Schema:
    return {"type": "string", "enum": list(values)}


def leaf(kind: str, values: list[str] | None = None) -> Schema:
    """A cell, field or answer of a declared kind; dates are strings."""
    if kind in ("enum", "choice") and values:
        return one_of(*values)
    return {"type": kind if kind in ("number", "boolean") else "string"}


def block_value(kind: str, columns: dict[str, Schema] | None = None, *, most: int | None = None, least: int | None = None, material: bool = False) -> Schema:
    """What fills a block: prose, list, table (rows of columns), keyvalue (fields) or image_ref.

    Tables have at most ``most`` rows, or CEILING; at least ``least`` only where
    there is material to fill rows from.
    """
    if kind == "prose":
        return {"type": "string"}
    if kind == "keyvalue":
        return record(**(columns or {}))
    if kind == "table":
        return many(record(**(columns or {})), most or CEILING, (least or None) if material else None)
    return many("string", CEILING)


def mentions(points: list[str]) -> Schema:
    """A verdict on every required point."""
    return record(points=many(record(point=one_of(*points), established="boolean", quote="string"), len(points), len(points)), confidence="number")


def placements(sections: list[str], nowhere: str, chars: int = 0) -> Schema:
    """Passages with the section that each belongs to; more of them for longer texts."""
    most = max(1, min(MOST_PLACED, max(5 * len(sections), chars // 100)))
    return record(assignments=many(record(section=one_of(nowhere, *sections), quote="string", why="string"), most, 1), confidence="number")


def prefilled(questions: dict[str, Schema]) -> Schema:
    """An answer to each question by its key."""
    return record(answers=record(**{k: record(found="boolean", quote="string", value=of) for k, of in questions.items()}))


def passage_answer(kind: str = "text", options: list[str] | None = None) -> Schema:
    """Whether one passage answers one question; a number stays as the passage writes it."""
    value = one_of("true", "false") if kind == "boolean" else leaf(kind, options) if kind == "choice" else {"type": "string"}
    return record(found="boolean", quote="string", value=value, confidence="number")


def captions(count: int) -> Schema:
    return record(captions=many(record(n="integer", caption="string", evidence="boolean"), count, count))


def draft(value: Schema) -> Schema:
    return record(value=value, gaps=many(record(question="string", why="string"), 6), confidence="number", based_on=many("string", 8))


def revision(value: Schema) -> Schema:
    return record(value=value, rationale="string")


PATTERN = record(pattern="string", note="string")
KEYWORDS = record(terms=many(record(term="string", why="string"), 12))
CRITERION = record(title="string", kind=one_of("mentions", "rubric"), must_mention=many("string", 8), rubric="string")
QUESTIONS = record(questions=many(record(prompt="string", type=one_of("text", "choice", "date", "number"), options=many("string", 8), hint="string", why="string"), 5, 1))
JUDGEMENT = record(result=one_of("pass", "fail", "not_applicable"), reason="string", confidence="number")
