"""All registered queries and their SQL twins."""

from weftgraph.catalog import codebase, graphs, joins, ranking, reports, search, text, upkeep  # noqa: F401
from weftgraph.catalog.base import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
