"""All queries of the library proper, by name."""

from __future__ import annotations

from .plans import queries as _plans
from .plans import service_queries, source_queries  # noqa: F401 - they register theirs

QUERIES = dict(_plans.QUERIES)
ORACLES = dict(_plans.ORACLES)
