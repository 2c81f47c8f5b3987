"""The registered queries over the test tables, and the SQL that checks them."""

from __future__ import annotations

from clearlines.queries import gates, jobs, latency, scores, text  # noqa: F401  (each registers its queries)
from clearlines.queries.jobs import flagship
from clearlines.queries.registry import ORACLES, QUERIES

__all__ = ["all_oracles", "all_queries", "flagship"]


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
