"""Every registered query of the engine, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from .plans import audit_plans, final_plans, merge_plans, more_plans, pair_plans, structure_plans, text_plans  # noqa: F401  modules register their queries on import
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = "prv_provenance"
