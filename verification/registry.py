"""All verification queries."""

from verification import queries_pages, queries_sites, queries_streams  # noqa: F401
from verification.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
