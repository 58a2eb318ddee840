"""Operators of a training-data pipeline, and the queries that apply them to the given tables."""

from tidemark.llm.registry import oracle_sql, queries

__all__ = ["queries", "oracle_sql"]
