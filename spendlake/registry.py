"""All queries of the library by name, with their SQL."""

from .plans import exploration, opportunities, reports  # they add their queries
from .plans.analytics import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "exploration", "opportunities", "reports"]
