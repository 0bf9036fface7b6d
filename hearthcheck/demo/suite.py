"""All registered queries. Importing this module fills the registry."""

from hearthcheck.demo import suite_audit, suite_field, suite_sources, suite_tables, suite_text  # noqa: F401
from hearthcheck.demo.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
