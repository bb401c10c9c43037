"""Named queries over the shared test tables, each with its SQL counterpart where
SQL can state it. Modules register themselves on import."""

from .base import QUERIES, SQL
from . import apportionment, check_families, checks, cleaning, elections, preferences, relations, shaping

__all__ = ["QUERIES", "SQL", "apportionment", "check_families", "checks", "cleaning", "elections", "preferences", "relations", "shaping"]
