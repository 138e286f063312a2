"""All queries of the core, and the SQL that states the same."""

from __future__ import annotations

from quillspan.plans import found, further, releases, resolve, rollups, search, store, texts, views

QUERIES = dict(found.QUERIES)
SQL = dict(found.SQL)
for _module in (rollups, releases, store, search, resolve, texts, views, further):
    QUERIES |= _module.BOOK.queries
    SQL |= _module.BOOK.sql
