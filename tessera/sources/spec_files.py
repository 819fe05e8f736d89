"""Document types in YAML as tables, and back.

A type is a few kilobytes that a person writes, so it is read on the driver; the
tables it becomes are what checks and lints join with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SECTIONS = "spec string, section string, title string, position int"
BLOCKS = "spec string, section string, block string, kind string, position int"
COLUMNS = "spec string, section string, block string, column string, type string, position int"
EDGES = "spec string, section string, depends_on string"
REQUIREMENTS = "spec string, id string, section string, block string, kind string, severity string, position int"


def parsed(text: str) -> dict:
    """A type from YAML text."""
    import yaml

    found = yaml.safe_load(text)
    if not isinstance(found, dict) or "sections" not in found:
        raise ValueError("a document type needs sections")
    return found


def dumped(spec: dict) -> str:
    """YAML text that :func:`parsed` reads back as the same type."""
    import yaml

    return yaml.safe_dump(spec, allow_unicode=True, sort_keys=False)


def tables(spark: SparkSession, specs: dict[str, dict]) -> dict[str, DataFrame]:
    """Sections, blocks, columns, edges and requirements of types by name."""
    sections, blocks, columns, edges, needs = [], [], [], [], []
    for name, spec in specs.items():
        for i, section in enumerate(spec["sections"]):
            key = section["key"]
            sections.append((name, key, section.get("title", key), i))
            edges += [(name, key, other) for other in section.get("depends_on") or []]
            for j, block in enumerate(section.get("blocks") or []):
                blocks.append((name, key, block["key"], block.get("kind", "prose"), j))
                cells = block.get("columns") or block.get("fields") or []
                columns += [(name, key, block["key"], c["key"], c.get("type", "string"), k) for k, c in enumerate(cells)]
            for j, need in enumerate(section.get("requirements") or []):
                needs.append((name, need["id"], key, need.get("block"), need["kind"], need.get("severity", "blocker"), j))
    made = (("sections", sections, SECTIONS), ("blocks", blocks, BLOCKS), ("columns", columns, COLUMNS), ("edges", edges, EDGES), ("requirements", needs, REQUIREMENTS))
    return {n: spark.createDataFrame(rows, schema) for n, rows, schema in made}
