"""All registered queries."""

from fleetbump.queries import (  # noqa: F401
    audit_queries,
    catalog_queries,
    corpus_queries,
    plan_queries,
    rule_queries,
    source_queries,
    status_queries,
    stream_queries,
    version_queries,
)
from fleetbump.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
