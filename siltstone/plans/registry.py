"""All queries and the SQL that DuckDB runs for them."""

from __future__ import annotations

from siltstone.plans import fetching, logs, reading, sites, texts, web

_PLANS = (texts, web, logs, sites, fetching, reading)
QUERIES = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
