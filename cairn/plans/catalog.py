"""All queries over the shared tables, and the SQL that must agree."""

from cairn.plans import decision_queries, geometry_queries, source_queries, text_queries  # noqa: F401  they register
from cairn.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
