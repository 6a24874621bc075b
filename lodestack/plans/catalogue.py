"""The registered queries over the engine's operators, and their SQL."""

from __future__ import annotations

from lodestack.plans import aggregates, composition, filters, more, projections, retrieval

QUERIES: dict = filters.QUERIES | aggregates.QUERIES | retrieval.QUERIES | more.QUERIES | composition.QUERIES | projections.QUERIES
SQL: dict[str, str] = filters.SQL | aggregates.SQL | retrieval.SQL | more.SQL | composition.SQL | projections.SQL
