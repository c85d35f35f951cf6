"""Names of the core queries and their SQL."""

from __future__ import annotations

from garimpo.plans import answers, scoring, texts

PARTS = (answers, scoring, texts)
FLAGSHIP = "flat_metrics_global"


def queries() -> dict:
    return {name: q for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for part in PARTS for name, q in part.SQL.items()}
