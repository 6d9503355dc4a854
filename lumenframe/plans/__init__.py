"""Queries of all operators."""

from lumenframe.plans import queries as _queries  # noqa: F401
from lumenframe.plans import rule_queries as _rule_queries  # noqa: F401
from lumenframe.plans import scalar_queries as _scalar_queries  # noqa: F401
from lumenframe.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
