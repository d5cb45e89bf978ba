"""All queries of the library, with the SQL of those that have one."""

from . import changes, evaluation, indexes, modes, records, states  # noqa: F401  they register their queries
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
