"""Every operator as a query over the given tables, with SQL to check it against."""

from hierfeat.catalog import hierarchy, jobs, learning, roundtrips, samples, scoring  # noqa: F401
from hierfeat.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
