"""All queries of the library by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.plans import answers, assembly, documents, events, files, findings, forms, judged, orders, reports, sections, specs, values
from tessera.plans.query import ORACLES, QUERIES

MODULES = (answers, assembly, documents, events, files, findings, forms, judged, orders, reports, sections, specs, values)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
