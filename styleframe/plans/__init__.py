"""Registered queries: each is (spark, sf_dir) -> DataFrame plus, where the
semantics are expressible in SQL, an independent DuckDB oracle."""

from styleframe.plans.registry import REGISTRY, oracle_sql, queries  # noqa: F401
