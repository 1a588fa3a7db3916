"""Composed jobs: the query registry, oracle SQL and pipelines."""
