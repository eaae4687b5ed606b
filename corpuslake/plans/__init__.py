"""Queries over the stored tables, each with its DuckDB twin where SQL can express it."""

from corpuslake.plans import q_graph, q_relations, q_text
from corpuslake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "q_graph", "q_relations", "q_text"]
