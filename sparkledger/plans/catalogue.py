"""The query catalogue: name -> query, name -> DuckDB SQL."""

from __future__ import annotations

from . import checks, files, helpers, running, scoring

QUERIES: dict = {**scoring.QUERIES, **running.QUERIES, **files.QUERIES, **helpers.QUERIES, **checks.QUERIES}
ORACLE_SQL: dict[str, str] = {**scoring.SQL, **running.SQL, **files.SQL, **helpers.SQL, **checks.SQL}
