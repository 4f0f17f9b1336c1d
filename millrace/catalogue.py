"""Every registered query of the engine, with its SQL for the oracle."""

from __future__ import annotations

from .operators import aggregates, changes, compat, joins, scans

MODULES = (scans, aggregates, joins, changes, compat)
QUERIES = {k: v for m in MODULES for k, v in m.R.queries.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.R.sql.items()}
