"""The catalog of queries."""

from __future__ import annotations

from .registry import Catalog


def catalogs() -> list[Catalog]:
    from . import detection, jobs, known, layout, records

    return [detection.CATALOG, known.CATALOG, records.CATALOG, layout.CATALOG, jobs.CATALOG]
