"""Every query of the engine by name, and the SQL that each is compared with."""

from . import plugin_queries, report_queries, sequence_queries, signal_queries, source_queries, study_queries, table_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
