"""All queries of the grid, placement, rule and generator operators, and their SQL."""

from __future__ import annotations

from gridloom.plans import assembly, audit, fields, oracles, queries, records, worlds

QUERIES = queries.QUERIES | records.QUERIES | audit.QUERIES | assembly.QUERIES | fields.QUERIES | worlds.QUERIES
SQL = oracles.SQL | records.SQL | audit.SQL | assembly.SQL | fields.SQL | worlds.SQL
