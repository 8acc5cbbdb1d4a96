"""All registered queries with their SQL."""

from __future__ import annotations

from lingualoom.plans import (
    catalog_eval,
    catalog_inline,
    catalog_office,
    catalog_stream,
    catalog_tables,
    catalog_text,
)

_PARTS = (catalog_text, catalog_eval, catalog_office, catalog_inline, catalog_tables, catalog_stream)

QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
