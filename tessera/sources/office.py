"""Word documents to units, from the parts of their archive."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

# The document's namespace, and how heading styles begin in five languages.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
HEADINGS = ("heading", "überschrift", "titre", "titolo", "title", "titel")


def _text(node: ElementTree.Element) -> str:
    return "".join("\t" if t.tag == f"{_W}tab" else t.text or "" for t in node.iter() if t.tag in (f"{_W}t", f"{_W}tab")).strip()


def _level(style: str) -> int:
    """The level of a heading style; 0 for other styles."""
    plain = style.lower().replace("berschrift", "überschrift") if style.lower().startswith("berschrift") else style.lower()
    if not plain.startswith(HEADINGS):
        return 0
    digit = re.search(r"\d", plain)
    return int(digit.group()) if digit else 1


def units(content: bytes) -> list[dict]:
    """Units in the order of the body; tables give a unit for each row, with the names of a full header row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out, trail = [], []
    for node in body:
        if node.tag == f"{_W}p" and (text := _text(node)):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = _level(style.get(f"{_W}val", "")) if style is not None else 0
            if level:
                trail = [x for x in trail if x[0] < level]
            out.append({"kind": "heading" if level else "text", "text": text, "path": [t for _, t in trail]})
            if level:
                trail.append((level, text))
        elif node.tag == f"{_W}tbl":
            rows = [[_text(c) for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            named = len(rows) > 1 and all(rows[0])
            for row in rows[1:] if named else rows:
                cells = [f"{h}: {c}" for h, c in zip(rows[0], row, strict=False) if c] if named else [c for c in row if c]
                if cells:
                    out.append({"kind": "table_row", "text": " · ".join(cells), "path": [t for _, t in trail]})
    return out


def parsed(files: DataFrame, key: str, content: str) -> DataFrame:
    """``key``, units and error of Word files; a file that cannot be read gives its error."""
    kind = dict(files.dtypes)[key]
    unit = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("path", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for raw in batch.column(1).to_pylist():
                try:
                    found.append(units(raw or b""))
                    errors.append(None)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, unit), pa.array(errors, pa.string())], ["key", "units", "error"])

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, units array<struct<kind:string,text:string,path:array<string>>>, error string")
