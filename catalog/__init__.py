"""Queries over the driver tables, each with the SQL that must give the same rows."""

from catalog import (  # noqa: F401
    aggregates,
    filters,
    flows,
    joins,
    normalize,
    ranking,
    records,
    scalars,
    sinks,
    sources,
    streams,
    trees,
)
from catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
