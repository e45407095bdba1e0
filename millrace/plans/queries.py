"""Named queries over the test tables, by the inventory's numbers, and the SQL that gives the same rows."""

from __future__ import annotations

from .registry import QUERIES, SQL  # noqa: F401
from . import q_gates, q_relations, q_dedup, q_scores, q_sources, q_tables, q_more, q_eval, q_build  # noqa: F401  each registers its queries

FLAGSHIP = "v02_gate_funnel"
