"""Quality control and analytics for household-survey tables, as Spark DataFrame jobs."""

from hearthcheck.plans.catalog import TableSet
from hearthcheck.session import build_session

__all__ = ["TableSet", "build_session"]
