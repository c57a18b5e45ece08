"""All registered queries and their SQL twins."""

from . import feeds, merges, rounds, sides, tables, trees  # noqa: F401  registering
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
